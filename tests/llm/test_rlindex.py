import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import rlindex, windows

DOCS = "doc_id long, text string"


def slow(rows, window):
    """By definition; rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    alphabet = [b"ab", b"abc", bytes(range(256)), b"\x00\x01\xff"][seed % 4]
    text = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    base = [text(rng.randrange(1, 40)) for _ in range(5)]
    indexed = [b"".join(rng.choice(base) for _ in range(rng.randrange(1, 5))) for _ in range(25)]
    docs = np.array([rng.randrange(10) for _ in indexed])
    asked = indexed + [b"".join(rng.choice([*base, text(3)]) for _ in range(3)) for _ in range(25)] + [b"z" * 5, b"a"]
    for window in (3, 8, 20):
        first, lengths, least = rlindex.RunIndex(indexed, docs, window).matching_statistics(asked)
        for f, t in zip(first, asked):
            for k in range(len(t)):
                n = max((m for m in range(min(window, len(t) - k) + 1) if any(t[k : k + m] in x for x in indexed)), default=0)
                assert lengths[f + k] == n
                if n == window:
                    assert least[f + k] == min(d for d, x in zip(docs, indexed) if t[k : k + n] in x)


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randrange(8, 30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else say(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 7))]
        rows.append((i * 3 % 61, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 300), (104, "x" * 120), (105, "ab" * 200), (106, rows[0][1]), (99, rows[1][1]), (-5, "ba" * 60)]
    return rows


@pytest.mark.parametrize(("block", "shard"), [(300, 500), (1 << 20, 1 << 20)])
def test_equals_brute_force(spark, block, shard):
    rows = passages(block)
    df = spark.createDataFrame(rows, DOCS).withColumn("blob", F.lit("clash")).withColumn("marks", F.lit(1))
    want = slow(rows, 50)
    assert rows_of(rlindex.suffix_dedup(df, block=block, shard_bytes=shard)) == want
    assert sum(r[2] for r in want) > 2000


def test_small_windows_equal_brute_force(spark):
    rows = passages(9)[:30]
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(rlindex.suffix_dedup(df, window=17, gram=8, block=400)) == slow(rows, 17)


def test_edge_rows(spark):
    text = "the same passage of text that is over fifty bytes long, in two rows"
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in rlindex.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(text)), ("None", len(text))]
    assert rlindex.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(rlindex.query(spark, "/root/testdata/sf0.001")) == slow(rows, 50)


def test_null_and_repeated_ids_of_different_texts(spark):
    passage = "the same passage of text that is over fifty bytes long, in four rows"
    own = "".join(chr(97 + i * i % 23) for i in range(600))
    rows = [(1, passage), (None, "x" * 40 + own[:460] + passage), (None, "abc"), (None, passage), (5, own[100:140] + passage), (5, "de"), (5, own[:90] + "!" + own[100:400] * 2)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in rlindex.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect())
    stand_in = [((1 << 63) - 1 if i is None else i, t) for i, t in rows]
    want = sorted(("None" if i == (1 << 63) - 1 else str(i), n, g, h) for i, n, g, _, h in slow(stand_in, 50))
    assert got == want and {g for _, _, g, _ in got} > {0, len(passage)}


def test_rows_that_leave_follow_loads_not_blocks(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    blobs, _ = windows.spread(df, windows.Units(False, 50, 16, 1000), 20)  # some 90 blocks, 20 shards
    assert blobs.count() == 20
    blobs, _ = windows.spread(df, windows.Units(False, 50, 16, 1000, 30_000), 20)
    assert 20 < blobs.count() <= 20 * -(-sum(len(t.encode()) for _, t in rows) // 30_000)


@pytest.mark.parametrize("load", [1, 900, 4000])
def test_loads_equal_brute_force(spark, load):
    rows = passages(load)
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(rlindex.suffix_dedup(df, block=300, shard_bytes=500, load=load)) == slow(rows, 50)


def test_copies_without_other_texts_need_no_index(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, t) for i, t in enumerate(texts)] + [(90, texts[0][:200] + "!" + texts[0][200:])]
    df = spark.createDataFrame(rows, DOCS)
    blobs, _ = windows.spread(df, windows.Units(False, 50, 16, 4000), 1)
    shard = windows.Shard([r.blob for r in blobs.collect()])
    indexed, index = [], rlindex.RunIndex
    monkeypatch.setattr(rlindex, "RunIndex", lambda texts, *a: indexed.extend(texts) or index(texts, *a))
    which, start, stop = rlindex.locate(shard, 50)
    assert 0 < len(indexed) < len(shard.texts) / 4
    gone = {d: rlindex.mask(401, np.stack([start, stop], axis=1)[shard.doc[which] == d]).sum() for d in set(shard.doc.tolist())}
    assert gone == {i: n for i, _, n, *_ in slow(rows, 50)}
    assert rows_of(rlindex.suffix_dedup(df)) == slow(rows, 50)
