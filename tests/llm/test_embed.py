import numpy as np
import pytest

from maillake.llm import embed

VECS = "vec_id long, embedding array<float>"


def slow(ids, vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for v in vectors]
    width = max((len(v) for v, g in zip(vectors, good) if g), default=0)
    x = np.zeros((len(ids), width))
    for i, v in enumerate(vectors):
        if good[i]:
            x[i, : len(v)] = np.array(v, np.float32)
            x[i] /= np.linalg.norm(x[i])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted((ids[i], int(near[i].sum()), least[find(i)], ids[i] == least[find(i)]) for i in range(len(ids)))


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()))


@pytest.mark.parametrize("tile", [16, 64, 5000])
def test_equals_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(60, 24))
    near = np.vstack([b + rng.normal(size=(k, 24)) * s for b, k, s in zip(base, rng.integers(1, 9, 60), rng.uniform(0.02, 0.3, 60))])
    hot = rng.normal(size=24) + rng.normal(size=(120, 24)) * 0.08  # a group that is a third of the rows
    x = np.vstack([near, hot, near[:20], rng.normal(size=(40, 24)), near[:3] * 7]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VECS)
    want = slow(ids, [v.tolist() for v in x])
    assert rows_of(embed.near_dedup(df, tile=tile)) == want
    assert sum(r[1] for r in want) > 10_000


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0], [0.0, 1.0], [1e30, 1e30], [1e-30, 1e-30]]
    df = spark.createDataFrame(list(enumerate(vectors)), VECS)
    from pyspark.sql import functions as F

    df = df.withColumn("rep", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = {r[0]: tuple(r)[1:] for r in embed.near_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert all(got[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 5, 10))
    assert all(got[i] == (3, 6, i == 6) for i in (6, 7, 8, 9))
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert embed.near_dedup(spark.createDataFrame([], VECS)).count() == 0
    assert rows_of(embed.near_dedup(df.where("vec_id < 3")))[0] == (0, 0, 0, True)


def test_query_equals_brute_force(spark):
    r = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    assert rows_of(embed.query(spark, "/root/testdata/sf0.01")) == slow([x[0] for x in r], [x[1] for x in r])


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [1.0, 1.0]), (3, [1.0, 0.01]), (None, None)], VECS)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed.near_dedup(df).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("3", 1, "1", False), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 1, "1", False)]


def test_pairs_at_the_threshold_are_decided_by_the_vectors_as_they_came():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 40)).astype(np.float32).astype(float)
    x = embed._unit(np.vstack([x, x + rng.normal(size=x.shape) * 0.3]))
    threshold = float(np.sort((x @ x.T)[np.triu_indices(len(x), 1)])[-150])  # a pair lies on it
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.einsum("ik,jk->ij", x, x, optimize=False), 1) >= threshold))}
    got = {(i, j) for a, b in embed.linked(x, None, embed.basis(x), threshold) for i, j in zip(a.tolist(), b.tolist())}
    assert len(got) in (149, 150, 151) and {(int(a), int(b)) for a, b in want} - got <= {p for p in want if abs(x[p[0]] @ x[p[1]] - threshold) < 1e-15}
