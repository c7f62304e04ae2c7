"""Queries over the test tables and the SQL that states their results."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.functions import files, headers as H
from maillake.functions.mediatypes import KNOWN
from maillake.functions.mime import parse_messages
from maillake.functions.sql import text_udf
from maillake.operators import mail as M
from maillake.operators import render as R
from maillake.options import ConvertOptions
from maillake.plans import views as V
from maillake.ship import ship

SKIP = frozenset({"Spam", "Trash"})
SINCE, UNTIL = date(2024, 1, 2), date(2024, 1, 4)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def mails(sql: str) -> str:
    return f"WITH {V.MAIL} {sql}"


def atts(sql: str) -> str:
    return f"WITH {V.ATT} {sql}"


def runs(sql: str) -> str:
    return f"WITH {V.RUNS} {sql}"


SEP = "From 1@xxx Mon Jan 15 09:30:00 +0000 2024\n"


@query(mails("SELECT conv_id, turn, sha256(message_id || chr(10) || chr(10) || text || chr(10) || chr(10)) AS message_sha FROM mail WHERE nth = 0"))
def q01_split_messages(spark, d):
    from maillake.sources import mbox

    m = V.mail(spark, d).where("nth = 0")
    one = F.concat(F.lit(SEP), "message_id", F.lit("\n\n"), "text", F.lit("\n\n"))
    boxes = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))).alias("all"))
    boxes = boxes.select("conv_id", F.col("all.turn").alias("turns"), F.array_join(F.transform("all", lambda x: x["x"]), "").cast("binary").alias("box"))

    def split(batches):
        for b in batches:
            for conv, turns, box in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = mbox.split(box)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(parts), pa.int64()), pa.array(turns[: len(parts)] + [None] * (len(parts) - len(turns)), pa.int64()), pa.array(parts, pa.binary())], ["conv_id", "turn", "raw"])

    return boxes.mapInArrow(split, "conv_id bigint, turn bigint, raw binary").select("conv_id", "turn", F.sha2("raw", 256).alias("message_sha"))


@query(r"""WITH q AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^(>*From )', '>\1', 'g') AS t FROM documents)
SELECT doc_id, strlen(t)::BIGINT AS quoted_bytes, sha256(regexp_replace(t, '(?m)^>(>*From )', '\1', 'g')) AS text_sha FROM q""")
def q02_unescape_from(spark, d):
    t = V.read(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "(?md)^(>*From )", ">$1").alias("t"))
    return t.select("doc_id", F.octet_length("t").cast("long").alias("quoted_bytes"), F.sha2(H.unescape_from(F.col("t")).cast("binary"), 256).alias("text_sha"))


@query(mails("SELECT ordinal, head_start || chr(10) || 'Message-ID: ' || message_id || chr(10) || head_end AS head FROM mail"))
def q03_header_block(spark, d):
    return V.mail(spark, d, raw=True).select("ordinal", H.header_block(F.col("raw")).alias("head"))


@query(mails("SELECT ordinal, key FROM mail"))
def q04_message_key(spark, d):
    return V.mail(spark, d, raw=True).select("ordinal", H.message_key(H.header_block(H.latin(F.col("raw").cast("binary")))).alias("key"))


@query(mails("SELECT ordinal, sha1(unhex(sha1(head_start || chr(10) || head_end))) AS key FROM mail"))
def q05_key_fallback(spark, d):
    raw = V.raw_mail(F.lit("utf-8"), with_id=False)
    return V.mail(spark, d).select("ordinal", H.message_key(H.header_block(H.latin(raw.cast("binary")))).alias("key"))


@query(mails("SELECT ordinal, array_to_string(labels, '|') AS labels FROM mail"))
def q06_labels(spark, d):
    head = H.header_block(H.latin(F.col("raw").cast("binary")))
    return V.mail(spark, d, raw=True).select("ordinal", F.array_join(H.labels(H.labels_value(head)), "|").alias("labels"))


@query(mails("SELECT ordinal, message_id FROM mail WHERE NOT list_has_any(labels, ['Spam', 'Trash'])"))
def q07_skip_labels(spark, d):
    return M.without_labels(V.mail(spark, d), SKIP).select("ordinal", "message_id")


def _ranged(spark, d, tz):
    m = V.mail(spark, d).withColumn("here", M.local_time(F.col("utc_ts"), F.col("offset_s"), tz))
    return m.where(M.in_range(F.to_date("here"), SINCE, UNTIL)).select("ordinal", F.date_format("here", "yyyy-MM-dd HH:mm:ss").alias("here"))


@query(mails("SELECT ordinal, strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS here FROM mail WHERE local_ts::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'"))
def q08_date_range_sender(spark, d):
    return _ranged(spark, d, "sender")


@query(mails("SELECT ordinal, strftime(utc_ts, '%Y-%m-%d %H:%M:%S') AS here FROM mail WHERE utc_ts::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'"))
def q09_date_range_utc(spark, d):
    return _ranged(spark, d, "utc")


@query("""SELECT event_id, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS here FROM events
WHERE timezone('Asia/Tokyo', timezone('UTC', ts))::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'""")
def q10_date_range_iana(spark, d):
    e = V.read(spark, d, "events").withColumn("here", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo"))
    return e.where(M.in_range(F.to_date("here"), SINCE, UNTIL)).select("event_id", F.date_format("here", "yyyy-MM-dd HH:mm:ss").alias("here"))


@query(mails("SELECT ordinal, message_id FROM mail ORDER BY ordinal LIMIT 200"))
def q11_limit_first_n(spark, d):
    return V.mail(spark, d).select("ordinal", "message_id").orderBy("ordinal").limit(200)


@query(runs("SELECT event_id, path FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.path = cur.path)"))
def q12_incremental_new(spark, d):
    prev, cur = V.runs(spark, d)
    return M.not_known(cur, prev, "path").select("event_id", "path")


@query(runs("SELECT count(*)::BIGINT AS already_converted, count(DISTINCT path)::BIGINT AS keys FROM cur WHERE EXISTS (SELECT 1 FROM prev WHERE prev.path = cur.path)"))
def q13_already_converted(spark, d):
    prev, cur = V.runs(spark, d)
    return M.known_only(cur, prev, "path").agg(F.count("*").alias("already_converted"), F.countDistinct("path").alias("keys"))


@query(mails("SELECT ordinal, key FROM mail WHERE NOT list_has_any(labels, ['Spam', 'Trash']) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal) = 1"))
def q14_dedup_first_wins(spark, d):
    return M.first_wins(M.without_labels(V.mail(spark, d), SKIP).select("key", "ordinal", "labels")).select("ordinal", "key")


@query(mails("SELECT (count(*) - count(DISTINCT key))::BIGINT AS duplicates FROM mail WHERE NOT list_has_any(labels, ['Spam', 'Trash'])"))
def q15_dup_count(spark, d):
    return M.without_labels(V.mail(spark, d), SKIP).agg((F.count("*") - F.countDistinct("key")).alias("duplicates"))


_UNION = r"""u AS (SELECT key, list(labels ORDER BY ordinal) AS ls FROM mail GROUP BY key),
f AS (SELECT key, flatten(ls) AS l FROM u),
k AS (SELECT key, list_filter(l, lambda x, i: list_position(l, x) = i) AS run_labels FROM f)"""


@query(mails(f", {_UNION} SELECT key, array_to_string(run_labels, '|') AS run_labels FROM k"))
def q16_label_union(spark, d):
    return M.label_union(V.mail(spark, d)).select("key", F.array_join("run_labels", "|").alias("run_labels"))


@query(mails(f""", {_UNION}, own AS (SELECT key, labels FROM mail WHERE nth = 0)
SELECT own.key, array_to_string(labels || list_filter(run_labels, lambda x: NOT list_contains(labels, x)), '|') AS labels FROM own JOIN k USING (key)"""))
def q17_label_merge(spark, d):
    m = V.mail(spark, d)
    rows = m.where("nth = 0").select("key", "labels").join(M.label_union(m), "key")
    return rows.select("key", F.array_join(M.merged_labels(F.col("labels"), F.col("run_labels")), "|").alias("labels"))


@query(mails("""SELECT a.key, array_to_string(coalesce(b.labels, a.labels), '|') AS labels, coalesce(a.labels <> b.labels, FALSE) AS updated
FROM mail a LEFT JOIN (SELECT key, labels FROM mail WHERE nth = 1) b ON a.key = b.key WHERE a.nth = 0"""))
def q18_label_replace(spark, d):
    m = V.mail(spark, d)
    rows = m.where("nth = 0").select("key", "labels").join(m.where("nth = 1").select("key", F.col("labels").alias("now")), "key", "left")
    changed = F.coalesce(F.col("labels") != F.col("now"), F.lit(False))
    return rows.select("key", F.array_join(F.coalesce("now", "labels"), "|").alias("labels"), changed.alias("updated"))


_STATS = """, s AS (SELECT *, list_has_any(labels, ['Spam', 'Trash']) AS skip FROM mail),
r AS (SELECT *, CASE WHEN skip THEN 0 ELSE row_number() OVER (PARTITION BY key, skip ORDER BY ordinal) END AS nr FROM s),
t AS (SELECT count(*) FILTER (skip) AS skipped, count(*) FILTER (nr > 1) AS duplicates,
  count(*) FILTER (nr = 1 AND local_ts::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-04') AS ok,
  count(*) FILTER (nr = 1 AND local_ts::DATE NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-04') AS out_of_range FROM r)
SELECT skipped, duplicates, ok, out_of_range, skipped + ok + out_of_range AS processed FROM t"""


def _count(c):
    return F.count(F.when(c, 1))


@query(mails(_STATS))
def q19_run_stats(spark, d):
    m = V.mail(spark, d).select("ordinal", "key", "local_ts", H.skips(F.col("labels"), SKIP).alias("skip"))
    rest = M.ranked(m.where("not skip"))
    inside = M.in_range(F.to_date("local_ts"), SINCE, UNTIL)
    t = m.where("skip").select(F.lit("skipped").alias("s")).union(
        rest.select(F.when(F.col("copy") > 1, "duplicates").when(inside, "ok").otherwise("out_of_range").alias("s"))
    )
    names = ("skipped", "duplicates", "ok", "out_of_range")
    out = t.agg(*[_count(F.col("s") == n).alias(n) for n in names])
    return out.withColumn("processed", F.col("skipped") + F.col("ok") + F.col("out_of_range"))


@query(atts("SELECT doc_id, hash, 'attachments/' || substr(hash, 1, 2) || '/' || hash || '.bin' AS path FROM att"))
def q20_content_address(spark, d):
    h = files.hash_col(F.coalesce("text", F.lit("")))
    t = V.read(spark, d, "documents").select("doc_id", h.alias("hash"))
    return t.select("doc_id", "hash", files.address_col(F.col("hash"), F.lit(".bin")).alias("path"))


@query(atts("SELECT doc_id, name, ext FROM att"))
def q21_ext_for(spark, d):
    return V.att(spark, d).select("doc_id", "name", "ext")


_BEST = f""", used AS (SELECT hash, path, ext, count(*) AS n FROM att GROUP BY ALL),
best AS (SELECT hash, path FROM used QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ext NOT IN ({", ".join(f"'{x}'" for x in sorted(KNOWN))}), n DESC, path) = 1)"""


@query(atts(_BEST + """ SELECT a.hash, b.path, max(size)::BIGINT AS size, count(*)::BIGINT AS refs, string_agg(message_path, ',' ORDER BY doc_id) AS messages
FROM att a JOIN best b ON a.hash = b.hash GROUP BY a.hash, b.path"""))
def q22_att_index(spark, d):
    return M.attachment_index(V.att(spark, d)).select("hash", "path", "size", "refs", F.array_join("messages", ",").alias("messages"))


@query(atts("""SELECT hash, string_agg(name || '=' || n, ',' ORDER BY name) AS names FROM (SELECT hash, name, count(*) AS n FROM att GROUP BY ALL) GROUP BY hash"""))
def q23_att_names(spark, d):
    pair = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    return M.attachment_index(V.att(spark, d)).select("hash", F.array_join(F.transform(F.array_sort(F.map_entries("names")), pair), ",").alias("names"))


@query(atts(_BEST + " SELECT hash, path FROM best"))
def q24_canonical_path(spark, d):
    return M.canonical_paths(V.att(spark, d))


@query(atts(_BEST + " SELECT doc_id, message_path, b.path, a.path <> b.path AS moved FROM att a JOIN best b ON a.hash = b.hash"))
def q25_consolidated_refs(spark, d):
    a = V.att(spark, d).withColumn("old", F.col("path"))
    return M.consolidated(a).select("doc_id", "message_path", "path", (F.col("old") != F.col("path")).alias("moved"))


@query(atts(""", h AS (SELECT hash, max(size) AS size, count(*) AS n FROM att GROUP BY hash),
t AS (SELECT count(*) AS unique_attachments, sum(n)::BIGINT AS attachment_refs, sum(size)::BIGINT AS bytes_stored, sum(size * n)::BIGINT AS bytes_referenced FROM h)
SELECT *, round(100 * (bytes_referenced - bytes_stored) / bytes_referenced, 6) AS saved_percent FROM t"""))
def q26_att_bytes(spark, d):
    t = M.stored_bytes(V.att(spark, d))
    return t.withColumn("saved_percent", F.round(M.percent(F.col("bytes_referenced") - F.col("bytes_stored"), F.col("bytes_referenced")), 6))


@query(f"WITH {V.RUNS}, {V.ATT} SELECT path FROM prev UNION SELECT path FROM att UNION SELECT message_path FROM att")
def q27_previous_outputs(spark, d):
    prev, _ = V.runs(spark, d)
    a = V.att(spark, d)
    return prev.select("path").union(a.select("path")).union(a.select("message_path")).distinct()


@query(runs("SELECT path FROM prev EXCEPT SELECT path FROM cur"))
def q28_stale_files(spark, d):
    prev, cur = V.runs(spark, d)
    return M.stale(prev, cur)


@query(runs("""SELECT 'incremental' AS kind, path FROM (SELECT path FROM prev UNION SELECT path FROM cur)
UNION ALL SELECT 'prune', path FROM (SELECT DISTINCT path FROM cur)
UNION ALL SELECT 'plain', path FROM ((SELECT path FROM prev EXCEPT SELECT path FROM cur) UNION SELECT path FROM cur)"""))
def q29_ledger_next(spark, d):
    prev, cur = V.runs(spark, d)
    kinds = {"incremental": M.next_ledger(prev, cur, incremental=True), "prune": M.next_ledger(prev, cur, prune=True), "plain": M.stale(prev, cur).union(cur.select("path")).distinct()}
    a, b, c = (v.select(F.lit(k).alias("kind"), "path") for k, v in kinds.items())
    return a.union(b).union(c)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q30_manifest_last_wins(spark, d):
    return M.last_wins(V.read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


_SLUG = r"""coalesce(nullif(trim(substr(trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace({0}, '(?i)^\s*((aw|fwd|fw|re|wg)\s*:\s*)+', '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'no-subject')"""


@query(f"SELECT doc_id, {_SLUG.format("coalesce(text, '')")} AS slug FROM documents")
def q31_slugify(spark, d):
    return V.read(spark, d, "documents").select("doc_id", V.slug(F.coalesce("text", F.lit(""))).alias("slug"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '[\x00-\x1f/\\]', '_', 'g')), ''), 'attachment') AS name FROM documents""")
def q32_safe_name(spark, d):
    return V.read(spark, d, "documents").select("doc_id", files.safe_name_col(F.col("text")).alias("name"))


_PATH = f"strftime(local_ts, '%Y/%m/%Y-%m-%d-%H%M-') || {_SLUG.format('subject')} || '-' || substr(key, 1, 4) || '.md'"


@query(mails(f"SELECT ordinal, {_PATH} AS path FROM mail"))
def q33_relpath(spark, d):
    return V.mail(spark, d).select("ordinal", files.relpath_col(F.col("local_ts"), V.slug("subject"), F.col("key")).alias("path"))


@query(mails(f", p AS (SELECT {_PATH} AS path FROM mail) SELECT path, count(*)::BIGINT AS messages FROM p GROUP BY path HAVING count(*) > 1"))
def q34_path_collisions(spark, d):
    p = V.mail(spark, d).select(files.relpath_col(F.col("local_ts"), V.slug("subject"), F.col("key")).alias("path"))
    return p.groupBy("path").agg(F.count("*").alias("messages")).where("messages > 1")


def _front(paths):
    none = F.array().cast("array<string>")
    return {
        "message_id": F.col("message_id"), "date": F.date_format("local_ts", "yyyy-MM-dd'T'HH:mm:ss"), "from": F.lit("Alice <alice@example.com>"),
        "to": F.array(F.col("role")), "cc": none, "subject": F.col("subject"), "labels": F.col("labels"), "thread_id": F.lit(None).cast("string"),
        "body_kind": F.lit("plain"), "paths": paths,
    }


_J = "to_json({0})::VARCHAR"
_FRONT = f"""concat_ws(chr(10), '---', 'message_id: ' || {_J.format("message_id")}, 'date: "' || strftime(local_ts, '%Y-%m-%dT%H:%M:%S') || '"',
 'from: "Alice <alice@example.com>"', 'to: [' || {_J.format("role")} || ']', 'cc: []', 'subject: ' || {_J.format("subject")},
 'labels: [' || array_to_string(list_transform(labels, lambda x: to_json(x)::VARCHAR), ', ') || ']', 'thread_id: null', 'body: "plain"', 'attachments: [' || {{0}} || ']', '---')"""


@query(mails(f"SELECT ordinal, {_FRONT.format("''")} AS front FROM mail"))
def q35_yaml_front_matter(spark, d):
    return V.mail(spark, d).select("ordinal", R.front_matter(_front(F.array().cast("array<string>"))).alias("front"))


@query(f"""WITH {V.MAIL}, {V.ATT}, j AS (SELECT mail.*, a.path, a.name, a.size FROM mail LEFT JOIN att a ON a.doc_id = conv_id * 8 + turn)
SELECT ordinal, sha256({_FRONT.format("""coalesce('"' || path || '"', '')""")} || chr(10) || chr(10) || '# ' || CASE WHEN subject = '' THEN '(no subject)' ELSE subject END || chr(10) || chr(10)
 || CASE WHEN text = '' THEN '_(no body)_' ELSE text END || coalesce(chr(10) || chr(10) || '## Attachments' || chr(10) || chr(10) || '- [' || name || '](../../' || path || ') (' || format('{{:,}}', size) || ' bytes)', '') || chr(10)) AS page_sha FROM j""")
def q36_render_markdown(spark, d):
    a = V.att(spark, d).select("doc_id", F.array(F.struct("path", "name", "size")).alias("files"))
    m = V.mail(spark, d).withColumn("doc_id", F.col("conv_id") * 8 + F.col("turn")).join(a, "doc_id", "left")
    m = m.withColumn("files", F.coalesce("files", F.from_json(F.lit("[]"), "array<struct<path:string,name:string,size:bigint>>")))
    return m.select("ordinal", F.sha2(R.document(_front(None), F.col("text"), F.col("files"), F.lit(2)).cast("binary"), 256).alias("page_sha"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS body FROM conversations""")
def q37_strip_quotes(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoted = F.concat("text", F.lit("\n\nOn Monday, Bob <bob@example.org>\nwrote:\n\n> one\n>> two\n\n--- Original Message ---\nFrom: x\ny"))
    return c.select("conv_id", "turn", text_udf("strip_quotes")(quoted).alias("body"))


@query()
def q38_html_to_md(spark, d):
    return V.read(spark, d, "pages").select("page_id", text_udf("html_to_md")("html").alias("markdown"))


@query("SELECT page_id, FALSE AS leaks_script, FALSE AS leaks_style, FALSE AS leaks_tag, TRUE AS has_heading FROM pages")
def q39_html_drop_tags(spark, d):
    p = V.read(spark, d, "pages").select("page_id", text_udf("html_to_md")("html").alias("m"))
    m = F.col("m")
    return p.select("page_id", m.contains("track(").alias("leaks_script"), m.contains("margin:0").alias("leaks_style"), m.rlike("(?i)<(script|style|title|head|p|li|div)\\b").alias("leaks_tag"), m.rlike("(?m)^# ").alias("has_heading"))


_HREF = r"""WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))) AS href FROM pages)"""


@query(_HREF + r""" SELECT page_id, href, CASE WHEN href LIKE '//%' THEN 'https:' || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(href, '(?i)^javascript:') THEN href END AS target FROM h""")
def q40_dead_links(spark, d):
    from maillake.functions.text import link_target

    @F.pandas_udf("string")
    def target(s):
        return s.map(link_target)

    h = V.read(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)))).alias("href"))
    return h.select("page_id", "href", target("href").alias("target"))


@query(r"""WITH w AS (SELECT doc_id, list_transform(string_split(replace(replace(coalesce(text, ''), ' ', chr(160) || ' '), chr(160), ' '), chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE
  repeat(' ', (length(x) - length(ltrim(x)))::INT) || rtrim(regexp_replace(ltrim(x), ' {2,}', ' ', 'g')) || CASE WHEN x LIKE '%  ' THEN '  ' ELSE '' END END) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l, chr(10))) AS tidy_sha FROM w""")
def q41_tidy_whitespace(spark, d):
    padded = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("  "))
    return V.read(spark, d, "documents").select("doc_id", F.sha2(text_udf("tidy_whitespace")(padded).cast("binary"), 256).alias("tidy_sha"))


def _parsed(spark, d, charset=None, **options):
    m = V.mail(spark, d).select("*", V.raw_mail(F.lit("utf-8") if charset is None else charset).cast("binary").alias("raw"))
    rows = m.select(F.lit("mail").alias("file"), "ordinal", "raw").repartition(spark.sparkContext.defaultParallelism * 2)  # the table is a few large splits
    return parse_messages(rows, ConvertOptions(**options), keep_data=False)


@query(mails(r"""SELECT ordinal, key, subject, array_to_string(labels, '|') AS labels, message_id, 'Alice <alice@example.com>' AS sender,
 strftime(local_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN offset_s < 0 THEN '-' ELSE '+' END || lpad((abs(offset_s) // 3600)::VARCHAR, 2, '0') || ':00' AS date_iso,
 sha256(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS body_sha FROM mail"""))
def q42_mime_roundtrip(spark, d):
    p = _parsed(spark, d, skip_labels=frozenset())
    return p.select("ordinal", "msg.key", "msg.subject", F.array_join("msg.labels", "|").alias("labels"), "msg.message_id", "msg.sender", "msg.date_iso", F.sha2(F.col("msg.body").cast("binary"), 256).alias("body_sha"))


@query("""SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, substr(sha256(text), 1, 20) AS hash, strlen(text)::BIGINT AS size, '.txt' AS ext
FROM documents WHERE strlen(text) > 0""")
def q43_mime_attachments(spark, d):
    docs = V.read(spark, d, "documents").repartition(spark.sparkContext.defaultParallelism * 2)
    cut = "\n--b\n"
    raw = F.concat(
        F.lit("Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n" + cut + "Content-Type: text/plain\n\nbody" + cut),
        F.lit('Content-Type: text/plain; charset=utf-8\nContent-Disposition: attachment; filename="doc-'), F.col("doc_id"),
        F.lit('.txt"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.col("text").cast("binary")), F.lit("\n--b--\n"),
    )
    p = parse_messages(docs.select(F.lit("docs").alias("file"), F.col("doc_id").alias("ordinal"), raw.cast("binary").alias("raw")), keep_data=False)
    return p.select(F.col("ordinal").alias("doc_id"), F.explode("msg.attachments").alias("a")).select("doc_id", "a.name", "a.hash", "a.size", "a.ext")


@query(mails("""SELECT ordinal, CASE WHEN list_has_any(labels, ['Spam', 'Trash']) THEN 'label'
 WHEN local_ts::DATE NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-04' THEN 'date' WHEN conv_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM mail"""))
def q44_status_split(spark, d):
    charset = F.when(F.col("conv_id") % 5 == 0, "rot13").otherwise("utf-8")  # a codec that isn't of text
    return _parsed(spark, d, charset, since=SINCE, until=UNTIL).select("ordinal", "status")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def q45_stream_dedup(spark, d):
    import uuid

    base = V.scratch(spark)
    out = f"{base}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(V.read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    fresh = events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    q = fresh.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{out}/rows")


@query(mails(_STATS))
def q46_dry_run_equals_real(spark, d):
    """The statistics of q19 once more, but from messages that were parsed in full."""
    m = V.mail(spark, d)
    first = M.first_wins(M.without_labels(m, SKIP).select("key", "ordinal", "labels"))
    raw = m.join(first.select("ordinal"), "ordinal", "left_semi").select(F.lit("mail").alias("file"), "ordinal", V.raw_mail(F.lit("utf-8")).cast("binary").alias("raw"))
    p = parse_messages(raw, ConvertOptions(since=SINCE, until=UNTIL), keep_data=False).select("status")
    skipped = m.where(H.skips(F.col("labels"), SKIP)).select(F.lit("label").alias("status"))
    extra = M.ranked(M.without_labels(m, SKIP).select("key", "ordinal", "labels")).where("copy > 1").select(F.lit("copy").alias("status"))
    t = p.union(skipped).union(extra).agg(
        _count(F.col("status") == "label").alias("skipped"), _count(F.col("status") == "copy").alias("duplicates"),
        _count(F.col("status") == "ok").alias("ok"), _count(F.col("status") == "date").alias("out_of_range"),
    )
    return t.withColumn("processed", F.col("skipped") + F.col("ok") + F.col("out_of_range"))


from maillake.plans import evidence  # noqa: E402, F401  (adds its queries)
