import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from maillake.llm import common, simhash

DOCS = "doc_id long, text string"


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def slow_components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_the_definition():
    cases = ["", None, "  \n", "One", "one TWO", "a b c", "É É é ÀB c d e f", "x " * 70_000, "A\x0bB\x1cC d e f g"]
    for t in cases:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_print(t)


def test_anchors_cover_one_bit():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 500, dtype=np.uint64)
    v[:2] = (0, 1 << 31)
    near = [set(r) for r in simhash.anchors(v).tolist()]
    assert all(bin(int(x) ^ a).count("1") <= 2 for x, s in zip(v, near) for a in s)
    for k in range(32):
        home = simhash.anchors(v ^ np.uint64(1 << k))[:, 0].tolist()
        assert all(h in s for h, s in zip(home, near))


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for k in range(1, 6):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, rep long")
    got = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    want = {(i, j) for i in range(len(signed)) for j in range(i) if bin((signed[i] ^ signed[j]) & mask).count("1") <= 3}
    assert got == {tuple(sorted(x)) for x in want} and len(want) > 200


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r[0]: slow_print(r[1]) for r in rows}
    ids = list(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = slow_components(ids, pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_edge_rows(spark):
    rows = [(5, None), (9, ""), (3, " \n"), (7, "a b"), (8, "A  b"), (8, "A  b"), (1, "q")]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("anchor", F.lit(None).cast("int"))
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_dedup(df).collect())
    assert got == [(1, 1), (3, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 3)]
    assert simhash.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 3)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = slow_components({x for p in real for x in p}, real)
    assert got == want
    assert common.components(df.limit(0)).count() == 0
