import re

import corpus_pipeline as cp
import sentencepiece
from pyspark.sql import functions as F

from maillake.llm import langid, pieces
from tests.llm.test_langid import slow_query
from tests.llm.test_mixing import slow_mix
from tests.llm.test_simhash import slow_components, slow_print


def slow_run(spark, docs):
    """The stages on plain rows, by definition; of the library only the fitted piece probabilities are taken."""
    model = langid.fit(docs)
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    predict, _ = slow_query([])
    found = {i: predict(model, r["text"]) for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if found[i][0] != "und" and found[i][1] >= 0.5}
    groups = {}
    for i, r in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), i))
    rows = {i: rows[i] for i in (min(g)[1] for g in groups.values())}
    prints = {i: slow_print(r["text"]) for i, r in rows.items()}
    pairs = [(a, b) for a in rows for b in rows if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    rows = {i: rows[i] for i, c in slow_components(list(rows), pairs).items() if i == c}
    copies = {i: x[3] for i, x in slow_mix([(i, r["text"], r["source"], r["lang"]) for i, r in rows.items()]).items()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return sorted((i, library.encode(r["text"])) for i, r in rows.items() for _ in range(copies[i]))


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = slow_run(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    got = sorted((r.doc_id, r.ids) for r in cp.run(spark, sf).collect())
    assert got == want and len(got) > 20 and len({i for i, _ in got}) < len(got)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("hit", F.lit("clash")).withColumn("bucket", F.lit(1))
    bad = docs.limit(2).select((F.col("doc_id") + 10_000).alias("doc_id"), F.lit(None).cast("string").alias("text"), *docs.columns[2:])
    now = docs.union(bad)
    for name, stage in cp.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, "")
        assert now.columns == docs.columns
        path = f"{tmp_path}/{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        if name == "language ID":
            assert now.count() == before - 2
    assert 0 < now.count() < docs.count()


def test_empty_table(spark):
    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_null_and_repeated_ids_are_dropped_by_their_own_text(spark):
    same, other = "The quick brown fox and the lazy dog are here.", "Une phrase qui est tout autre chose que les autres."
    rows = [(1, same), (1, other), (2, same + " "), (None, same), (None, other + "!"), (3, other + "!"), (3, other + "!"), (None, "x y z"), (None, "x  y z")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = sorted((str(r.doc_id), r.text) for r in cp.exact_dedup(spark, docs, "").collect())
    assert exact == sorted([("2", same + " "), ("1", other), ("3", other + "!"), ("None", "x  y z")])
    near = cp.near_dedup(spark, docs, "").collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(slow_print(t), set()).add((i is None, i or 0))
    assert len(near) <= len(prints) and {(r.doc_id is None, r.doc_id or 0) for r in near} <= {min(ids) for ids in prints.values()}
