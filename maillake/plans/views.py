"""Mail, attachments and run paths derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maillake.functions import files, headers
from maillake.functions.sql import text_udf

_LABELS = ("Spam", "Inbox,Important", "Opened,Trash", "Inbox, Opened", "", "Sent", "Archived,Receipts/2024")
_SUFFIX = (".txt", ".md", ".pdf", ".e3fc6c20", ".zzq")
_TYPE = ("text/plain", "text/markdown", "application/octet-stream", "application/pdf", "application/x-unknown")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one with a local master only."""
    import tempfile

    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.removeprefix("file://") if named else tempfile.mkdtemp(prefix="maillake-")


def pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def mail(spark: SparkSession, d: str, raw: bool = False) -> DataFrame:
    """A mailbox made of conversations; every third turn comes twice. With `raw` the message text too."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = c.withColumn("nth", F.lit(0)).union(c.where("turn % 3 = 0").withColumn("nth", F.lit(1)))
    first = F.trim(F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 60), "[^ -~]", "?"))
    offset = ((F.col("conv_id") % 25 - 12) * 3600).cast("int")
    m = m.select(
        "*",
        (F.col("nth") * 1_000_000_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
        F.concat(F.lit("<c"), "conv_id", F.lit("."), "turn", F.lit("@fixtures.example.com>")).alias("message_id"),
        pick(_LABELS, F.col("conv_id") + F.col("nth")).alias("label_text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("local_ts"),
        offset.alias("offset_s"),
        F.concat(F.when(F.col("turn") > 0, "Re: ").otherwise(""), first).alias("subject"),
    )
    m = m.withColumns({"utc_ts": F.timestamp_seconds(F.unix_timestamp("local_ts") - F.col("offset_s")), "labels": headers.labels(F.col("label_text")), "key": F.sha1("message_id")})
    if raw:
        m = m.withColumn("raw", raw_mail(F.lit("utf-8")))
    return m


def rfc_date(local: Column, offset_s: Column) -> Column:
    h = F.abs(offset_s / 3600).cast("int")
    zone = F.concat(F.when(offset_s < 0, "-").otherwise("+"), F.lpad(h.cast("string"), 2, "0"), F.lit("00"))
    return F.concat_ws(" ", F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"), zone)


def raw_mail(charset: Column, with_id: bool = True) -> Column:
    head = ["From: Alice <alice@example.com>\n"]
    cols = [F.lit(head[0]), F.lit("Date: "), rfc_date(F.col("local_ts"), F.col("offset_s"))]
    if with_id:
        cols += [F.lit("\nMessage-ID: "), F.col("message_id")]
    cols += [F.lit("\nSubject: "), F.col("subject"), F.lit("\nX-Gmail-Labels: "), F.col("label_text")]
    cols += [F.lit("\nContent-Type: text/plain; charset="), charset, F.lit("\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text"), F.lit("\n")]
    return F.concat(*cols)


MAIL = r"""c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, 0 AS nth FROM c UNION ALL SELECT *, 1 FROM c WHERE turn % 3 = 0),
m AS (SELECT *, nth * 1000000000000 + conv_id * 1000 + turn AS ordinal,
    '<c' || conv_id || '.' || turn || '@fixtures.example.com>' AS message_id,
    ['Spam', 'Inbox,Important', 'Opened,Trash', 'Inbox, Opened', '', 'Sent', 'Archived,Receipts/2024'][((conv_id + nth) % 7)::INT + 1] AS label_text,
    make_timestamp((1704067200 + conv_id * 3600 + turn * 60)::BIGINT * 1000000) AS local_ts,
    (conv_id % 25 - 12) * 3600 AS offset_s,
    CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || trim(regexp_replace(substr(split_part(text, chr(10), 1), 1, 60), '[^ -~]', '?', 'g')) AS subject
  FROM n),
mail AS (SELECT *, local_ts - to_seconds(offset_s) AS utc_ts, sha1(message_id) AS key,
    list_filter(list_transform(string_split(label_text, ','), lambda x: trim(x)), lambda x: x <> '') AS labels,
    'From: Alice <alice@example.com>' || chr(10) || 'Date: ' || strftime(local_ts, '%a, %d %b %Y %H:%M:%S ') || CASE WHEN offset_s < 0 THEN '-' ELSE '+' END || lpad((abs(offset_s) // 3600)::VARCHAR, 2, '0') || '00' AS head_start,
    'Subject: ' || subject || chr(10) || 'X-Gmail-Labels: ' || label_text || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' AS head_end
  FROM m)"""


def att(spark: SparkSession, d: str) -> DataFrame:
    """Attachments made of documents: references with stored paths."""
    a = read(spark, d, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("message_path"), F.coalesce("text", F.lit("")).alias("data"),
        F.concat(F.lit("doc-"), "doc_id", pick(_SUFFIX, F.col("doc_id"))).alias("name"), pick(_TYPE, F.col("doc_id")).alias("media_type"),
    )
    a = a.withColumns({"hash": files.hash_col(F.col("data")), "size": F.octet_length("data").cast("long"), "ext": files.ext_col(F.col("name"), F.col("media_type"), F.col("data"))})
    return a.withColumns({"path": files.address_col(F.col("hash"), F.col("ext")), "seq": F.col("doc_id")})


ATT = r"""a0 AS (SELECT doc_id, coalesce(source, '') AS message_path, coalesce(text, '') AS data,
    'doc-' || doc_id || ['.txt', '.md', '.pdf', '.e3fc6c20', '.zzq'][(doc_id % 5)::INT + 1] AS name,
    ['.txt', '.md', '.pdf', '.pdf', '.zzq'][(doc_id % 5)::INT + 1] AS ext FROM documents),
att AS (SELECT *, substr(sha256(data), 1, 20) AS hash, strlen(data)::BIGINT AS size,
    'attachments/' || substr(sha256(data), 1, 2) || '/' || substr(sha256(data), 1, 20) || ext AS path FROM a0)"""


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paths of an earlier run and of the current one, whose days overlap; every event is in one of them."""
    e = read(spark, d, "events").select("event_id", F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), "user_id").alias("path"), "ts")
    return e.where("ts < timestamp_ntz '2024-01-16 00:00:00'"), e.where("ts >= timestamp_ntz '2024-01-10 00:00:00'")


RUNS = r"""e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') || '/' || user_id AS path, ts FROM events),
prev AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-16'), cur AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-10')"""


def slug(subject) -> Column:
    return text_udf("slugify")(subject)
