import numpy as np
from pyspark.sql import functions as F

from maillake.llm import mixing

DOCS = "doc_id long, text string, source string, lang string"
TARGETS = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 0.5, "table": 0.5, "noise": 0.2}}


def docs(spark, n=4000):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        source = "a" if rng.random() < 0.8 else rng.choice(["b", "c"])
        text = " | ".join(["w"] * int(rng.integers(1, 30))) if rng.random() < 0.3 else "w " * int(rng.integers(1, 60))
        rows.append((i, text, str(source), str(rng.choice(["en", "de", "xx"], p=[0.5, 0.4, 0.1]))))
    return spark.createDataFrame(rows, DOCS)


def test_calibrated_weights_meet_the_marginals(spark):
    r = mixing.mix(docs(spark), TARGETS, keep=None).toPandas()
    total = r.n_tokens.sum()
    w = (r.n_tokens * r.weight).groupby(r.source).sum() / total
    other = r.n_tokens[r.source == mixing.OTHER].sum() / total
    np.testing.assert_allclose([w["a"], w["b"], w[mixing.OTHER]], [(1 - other) / 2, (1 - other) / 2, other], rtol=1e-6)
    w = (r.n_tokens * r.weight).groupby(r.lang).sum() / total
    other = r.n_tokens[r.lang == mixing.OTHER].sum() / total
    np.testing.assert_allclose([w["en"], w["de"]], [0.7 * (1 - other), 0.3 * (1 - other)], rtol=1e-6)
    w = (r.n_tokens * r.weight).groupby(r.topic).sum() / total
    np.testing.assert_allclose([w["prose"], w["table"]], [0.5, 0.5], rtol=1e-6)  # no noise: the others share
    assert r.probability.max() == 1 and (r.probability > 0).all()
    np.testing.assert_allclose(r.probability, r.weight / r.weight.max())


def test_sampled_tokens_follow_the_targets(spark):
    d = docs(spark, 20_000)
    r = mixing.mix(d, TARGETS, keep=None).toPandas()
    k = r[r.kept]
    share = k.n_tokens.groupby(k.source).sum() / k.n_tokens.sum()
    assert abs(share["a"] - share["b"]) < 0.04
    kept = mixing.sample(d, TARGETS, keep=None)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == set(k.doc_id)


def test_keep_sets_the_expected_share(spark):
    r = mixing.mix(docs(spark), TARGETS, keep=0.6).toPandas()
    assert abs((r.n_tokens * r.probability).sum() / r.n_tokens.sum() - 0.6) < 1e-6
    free = r[r.probability < 1]
    np.testing.assert_allclose(free.probability / free.weight, (free.probability / free.weight).iloc[0])
    assert (mixing.mix(docs(spark), TARGETS, keep=1.0).toPandas().probability == 1).all()


def test_rake_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    cells = rng.random((3, 4, 2)) * (rng.random((3, 4, 2)) > 0.2)
    want = [np.array([0.2, 0.3, 0.5]), np.full(4, 0.25), np.array([0.6, 0.4])]
    fit = cells / cells.sum()
    for _ in range(500):
        for axis in range(3):
            for k in range(cells.shape[axis]):
                at = tuple(k if a == axis else slice(None) for a in range(3))
                fit[at] *= want[axis][k] / fit[at].sum()
    np.testing.assert_allclose(mixing.rake(cells, want), fit, rtol=1e-6)


def test_tokens_and_topics_in_sql(spark, duck):
    got = mixing.query(spark, "/root/testdata/sf0.001")
    rows = got.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")).collect()
    sql = r"""SELECT source, lang, CASE WHEN regexp_matches(text, '(?i)\blicen[cs]e\b') THEN 'licence' WHEN contains(text, ' | ') THEN 'table'
      WHEN regexp_matches(text, '[%*&#$]{3}') THEN 'noise' ELSE 'prose' END AS topic,
      sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), count(*) FROM documents GROUP BY ALL"""
    assert sorted(map(tuple, rows)) == sorted(duck("sf0.001").sql(sql).fetchall())


def test_edge_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (3, "a b", "a", "en"), (3, "a b", "a", "en"), (None, "x", "zz", "de"), (5, "w " * 90_000, "b", "de")]
    df = spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit("clash")).withColumn("topic", F.lit("clash"))
    got = mixing.mix(df, TARGETS).collect()
    assert len(got) == 6 and [r.n_tokens for r in got if r.doc_id == 5] == [90_000]
    assert [(r.source, r.lang, r.n_tokens) for r in got if r.doc_id == 1] == [(mixing.OTHER, mixing.OTHER, 0)]
    assert mixing.sample(df, TARGETS).columns == df.columns
    assert mixing.mix(df.limit(0), TARGETS).count() == 0
    assert mixing.mix(df.where("doc_id <= 2"), TARGETS).count() == 2


def test_production_meets_the_marginals(spark):
    d = docs(spark, 20_000)
    r = mixing.mix(d, TARGETS).toPandas()
    total, tokens = r.n_tokens.sum(), r.n_tokens * r.copies
    assert r.weight.max() * mixing.KEEP > 1 and r.copies.max() > 1 and (r.kept == (r.copies > 0)).all()
    assert abs((r.n_tokens * r.weight).sum() / total - 1) < 1e-6 and abs(tokens.sum() / total - mixing.KEEP) < 0.02
    for marginal in ("source", "lang", "topic"):
        known = {k: v for k, v in TARGETS[marginal].items() if (r[marginal] == k).any()}
        rest = 1 - r.n_tokens[r[marginal] == mixing.OTHER].sum() / total
        for k, v in known.items():
            want = v / sum(known.values()) * rest
            assert abs((r.n_tokens * r.weight)[r[marginal] == k].sum() / total - want) < 1e-6
            assert abs(tokens[r[marginal] == k].sum() / tokens.sum() - want) < 0.02
    rows = mixing.sample(d, TARGETS).groupBy("doc_id").count().toPandas()
    assert dict(zip(rows.doc_id, rows["count"])) == dict(zip(r.doc_id[r.kept], r.copies[r.kept]))


def test_query_delivers_the_targets(spark):
    r = mixing.query(spark, "/root/testdata/sf0.1").toPandas()
    tokens = r.n_tokens * r.copies
    for marginal in ("source", "lang", "topic"):
        for k, v in mixing.TARGETS[marginal].items():
            assert abs(tokens[r[marginal] == k].sum() / tokens.sum() - v) < 0.015


def slow_mix(rows):
    """The production query by definition: rows (doc_id, text, source, lang) -> doc_id: (cell, tokens, weight, copies)."""
    import re
    import struct

    import xxhash

    def form(text):
        if text is not None and re.search(r"(?i)\blicen[cs]e\b", text):
            return "licence"
        if text is not None and " | " in text:
            return "table"
        return "noise" if text is not None and re.search(r"[%*&#$]{3}", text) else "prose"

    cell_of, tokens = {}, {}
    for i, text, source, lang in rows:
        kinds = (source, lang, form(text))
        cell_of[i] = tuple(k if k in mixing.TARGETS[m] else mixing.OTHER for k, m in zip(kinds, mixing.MARGINALS))
        tokens[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    cells = {}
    for i, c in cell_of.items():
        cells[c] = cells.get(c, 0) + tokens[i]
    total = sum(cells.values())
    fit = {c: n / total for c, n in cells.items()}
    for _ in range(200):
        for axis, m in enumerate(mixing.MARGINALS):
            have = {}
            for c, x in fit.items():
                have[c[axis]] = have.get(c[axis], 0) + x
            actual = {}
            for c, n in cells.items():
                actual[c[axis]] = actual.get(c[axis], 0) + n / total
            known = {k: v for k, v in mixing.TARGETS[m].items() if actual.get(k, 0) > 0}
            rest = 1 - actual.get(mixing.OTHER, 0)
            want = {k: v / sum(known.values()) * rest for k, v in known.items()} | {mixing.OTHER: actual.get(mixing.OTHER, 0)}
            fit = {c: x * (want.get(c[axis], 0) / have[c[axis]] if have[c[axis]] else 1) for c, x in fit.items()}
    out = {}
    for i, c in cell_of.items():
        weight = fit[c] / (cells[c] / total) if cells[c] else 1.0
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        draw = (xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), h) % (1 << 52)) / (1 << 52)
        rate = weight * mixing.KEEP
        out[i] = (c, tokens[i], weight, int(rate) + (draw < rate - int(rate)))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = slow_mix([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()])
    got = {r.doc_id: r for r in mixing.query(spark, sf).collect()}
    assert set(got) == set(want) and len(want) == 200
    for i, (cell, n, weight, copies) in want.items():
        r = got[i]
        assert ((r.source, r.lang, r.topic), r.n_tokens, r.copies, r.kept) == (cell, n, copies, copies > 0)
        np.testing.assert_allclose(r.weight, weight, rtol=1e-6)
        np.testing.assert_allclose(r.probability, min(1, weight * mixing.KEEP), rtol=1e-6)
