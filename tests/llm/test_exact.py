import hashlib
import re

from pyspark.sql import functions as F

from maillake.llm import exact

DOCS = "doc_id long, text string"


def test_query_equals_sql(same):
    same("op4_exact_dedup")


def test_edge_rows(spark):
    long = "word " * 50_000
    rows = [
        (1, None), (2, ""), (3, " \t"), (4, "ab"), (5, "a b"), (6, "a\nb "), (7, "a b"), (8, long), (9, long.strip()),
        (10, "x" * 64 + "1"), (11, "x" * 64 + "2"), (12, "same"), (12, "same"), (13, "é"), (14, "é"),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit(1)).withColumn("sha", F.lit("clash"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df, digest=True).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert got[i] == (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_full_text_is_read_for_survivors_only(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "ccc"), (4, "a a")], DOCS)
    positions = {r[0]: r[1] for r in df.select("doc_id", exact.id_position(F.col("doc_id"))).collect()}
    marked = set()
    for r in exact.survivors_bitmap(df).collect():
        marked |= {r.bucket * 32768 + 8 * i + k for i, b in enumerate(r.bits) for k in range(8) if b >> k & 1}
    assert marked == {positions[1], positions[4]}


def test_plan_has_no_python(spark):
    plan = exact.exact_dedup(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
