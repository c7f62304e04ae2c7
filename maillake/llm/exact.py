"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are equal when identical without white space. Rows are grouped by normalised length, the groups
that are left by a hash of the first characters, and only rows of groups that still have company are
read in full and compared by SHA-256. Of equal texts the row with the most code points, then the
smallest doc_id, stays.

What goes from one step to the next is narrow: ids, lengths and hashes. Rows that share a length, then a
length and prefix, are named by bitmaps (1 to 32 MB, whatever the input), which is all that is broadcast
but for the thousand largest groups; a false hit only costs a hash. Groups are pre-aggregated before every
shuffle, so a group of copies of any size is one row a task; rows of groups that hold more than a
thousandth of all rows find them by broadcast, so no hot group meets in one task.

Defined cases: null text is empty, and all empty texts are one group; a null doc_id sorts last; rows
that repeat a doc_id and text all count in group_size and share their fate (survivors() keeps one of
them); rows of one doc_id with different texts are judged each by its own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.llm.common import HIT, ROW, TWIN, bits_for, cut, id_bitmap, id_position, row_key, squeezed, table, with_group, with_hit, without

PREFIX = 64


def _survivors(docs: DataFrame) -> tuple[DataFrame, int]:
    norm = squeezed(F.col("text"))
    narrow = cut(docs.select("doc_id", F.length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head")))
    bits = bits_for(narrow.count())

    def shared(rows: DataFrame, *by: str) -> DataFrame:
        """The rows whose values of `by` others have too (and few more)."""
        groups = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
        key = F.struct(*by)
        return with_hit(rows, key, id_bitmap(groups.select(id_position(key, bits).alias("pos"))), bits).where(F.col(HIT)).drop(HIT)

    # refine by length, then by prefix; lone rows go nowhere
    left = shared(shared(narrow, "len"), "len", "head")
    return id_bitmap(left.select(id_position(F.col("doc_id"), bits).alias("pos"))), bits


def survivors_bitmap(docs: DataFrame) -> DataFrame:
    """(bucket, bits): the rows whose length and prefix hash others share."""
    return _survivors(docs)[0]


def _judged(docs: DataFrame, digest: bool) -> DataFrame:
    sha = F.sha2(squeezed(F.col("text")).cast("binary"), 256)
    bitmap, bits = _survivors(docs)
    rows = with_hit(docs.select("doc_id", "text", row_key().alias(ROW)), F.col("doc_id"), cut(bitmap), bits)
    full = cut(
        rows.select(
            "doc_id", ROW, F.col(HIT).alias("hit"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.when(F.col(HIT) | F.lit(digest), sha).alias("sha")
        )
    )
    found = full.where("hit")
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("low"), F.col(ROW).alias("row")))
    groups = cut(found.groupBy("sha").agg(F.count("*").alias("n"), (-best["low"]).alias("keep_id"), best["row"].alias("keep_row")).where("n > 1"))
    # rows that the bitmap lets pass are alone and meet no join
    alone = full.where("not hit").withColumns({"n": F.lit(None).cast("long"), "keep_id": F.lit(None).cast(groups.schema["keep_id"].dataType), "keep_row": F.lit(None).cast("long")})
    out = with_group(found, groups, "sha", full.count()).unionByName(alone)
    own = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("sha").alias("text_sha256"),
        ROW,
        (own | (F.col(ROW) == F.col("keep_row"))).alias("stays"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept; text_sha256 too if `digest`."""
    return _judged(docs, digest).select("doc_id", "keep_id", "group_size", "kept", *["text_sha256"] * digest)


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns kept: one of each group, also where rows repeat doc_id and text."""
    rows = _judged(docs, False).where("group_size > 1").groupBy("doc_id", ROW).agg(F.first("stays").alias("stays"), (F.count("*") > 1).alias(TWIN))
    return without(docs, rows.where(~F.col("stays") | F.col(TWIN)).withColumn(TWIN, F.col("stays")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h)::BIGINT AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
"""
