import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import tokencount as tc

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("block", [2, 4, 6, 64, 1 << 20])
def test_counts_are_stitched_across_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    want, names = {}, []
    for f in range(4):
        docs = [[rng.randrange(100) for _ in range(rng.choice([0, 0, 1, 2, 7, 40]))] for _ in range(rng.randrange(1, 9))]
        ids = [x for d in docs for x in [*d, tc.END]]
        if f % 2:
            ids += (tail := [5] * rng.randrange(3))
            docs += [tail] if tail else []
        path = f"file://{tmp_path}/{f}.bin"
        np.array(ids, "<u2").tofile(f"{tmp_path}/{f}.bin")
        names.append((path,))
        want |= {(path, k): len(d) for k, d in enumerate(docs)}
    open(f"{tmp_path}/empty.bin", "wb").close()
    names.append((f"file://{tmp_path}/empty.bin",))
    got = {(r.file, r.ordinal): r.n_tokens for r in tc.count_tokens(spark.createDataFrame(names, "file string"), block=block).collect()}
    assert got == want


def test_query_equals_the_tokenizer(spark):
    encode = tc._encoding(open(tc.RANKS, "rb").read()).encode_ordinary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: len(encode(r[1] or "")) for r in docs}
    assert {r.doc_id: r.n_tokens for r in tc.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "<|endoftext|>"), (5, "w " * 30_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("file", F.lit("clash")).withColumn("ordinal", F.lit(None).cast("int")).withColumn("n_tokens", F.lit("x"))
    written = tc.write_tokens(df, f"file://{tmp_path}")
    counts = tc.count_tokens(written.select("file").distinct())
    encode = tc._encoding(open(tc.RANKS, "rb").read()).encode_ordinary
    got = sorted((r.doc_id, r.n_tokens) for r in written.join(counts, ["file", "ordinal"]).collect())
    assert got == sorted((i, len(encode(t or ""))) for i, t in rows)
    assert tc.count_tokens(spark.createDataFrame([], "file string")).count() == 0
