import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maillake.llm import phrases

DOCS = "doc_id long, text string"


def slow(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [say(rng.randrange(20, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = sum((rng.choice(shared) if rng.random() < 0.5 else say(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))), [])
        rows.append((i * 7 % 61, rng.choice([" ", "\n ", "\t\x0b"]).join(parts)))
    same = " ".join(say(35))
    return rows + [(100, None), (101, " "), (102, "x " * 35), (103, "y " * 36), (104, "u v " * 60), (105, same + " end"), (105, same + " end"), (106, rows[3][1])]


@pytest.mark.parametrize(("block", "shard"), [(400, 600), (1 << 20, 1 << 20)])
def test_equals_brute_force(spark, block, shard):
    rows = passages(block)
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("hit", F.lit(1))
    want = slow(rows, 35)
    assert rows_of(phrases.phrase_dedup(df, block=block, shard_bytes=shard)) == want
    assert sum(r[2] for r in want) > 1500


def test_small_windows_equal_brute_force(spark):
    rows = passages(4)
    assert rows_of(phrases.phrase_dedup(spark.createDataFrame(rows, DOCS), window=5, gram=2, block=700)) == slow(rows, 5)


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = rows_of(phrases.phrase_dedup(spark.createDataFrame([(1, text), (2, text + " tail")], DOCS)))
    assert [r[:3] for r in got] == [(1, 40, 40), (2, 41, 40)]
    assert phrases.phrase_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(phrases.query(spark, "/root/testdata/sf0.001")) == slow(rows, 35)


def test_null_and_repeated_ids_of_different_texts(spark):
    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, say("p", 40)), (None, say("a", 100) + " " + say("p", 40)), (None, "abc"), (None, say("b", 150)), (5, say("c", 60) + " " + say("p", 40)), (5, "de"), (5, say("d", 120))]
    got = sorted((str(i), *x) for i, *x in map(tuple, phrases.phrase_dedup(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    stand_in = [(0 if i is None else i, t) for i, t in rows]
    assert got == sorted((str(i or None), *x) for i, *x in slow(stand_in, 35))
    assert sorted(x[2] for x in got) == [0] * 4 + [40] * 3
