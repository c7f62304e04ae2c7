"""Token counts by separator scan over flat, unindexed token files.

A token file is a bare run of little-endian 16-bit ids; each document ends with the end-of-document id.
Files are cut into blocks of fixed size. A first pass searches each block for separators, vectorised, and
keeps where its first and last lie and how many there are; a prefix scan over the blocks of a file then
gives each block the ordinal it starts at and the last separator before it, so that documents across
block edges are stitched; a second pass emits the count of every document. A file of any size is
many tasks, and only one row per block is shuffled.

Defined cases: a document without tokens counts 0; tokens after a file's last separator are one more
document; an empty file has none; null texts are written as empty; no files give an empty result. Files
must hold a whole number of ids.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maillake.llm.common import cut, lean, shared_dir, slices, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, WIDTH = 50256, 2
BLOCK = 4 << 20


@lru_cache(maxsize=1)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, ranks_path: str = RANKS) -> DataFrame:
    """Encode docs (doc_id, text) into one flat file per task; returns doc_id, file, ordinal.

    A task attempt has its own file and rows name the file of the attempt that made them, so a rerun
    task leaves at worst an unnamed file.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, fixed in size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value).encode_ordinary
        c = TaskContext.get()
        file = f"{folder}/tokens-{c.partitionId():06d}-{c.taskAttemptId()}.bin"
        fs, path = _open(file)
        ordinal = 0
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for b in slices(batch, 256):
                    ids: list[int] = []
                    for t in b.column(1).to_pylist():
                        ids += encode((t or b"").decode("utf-8", "replace"))
                        ids.append(END)
                    out.write(np.array(ids, "<u2").tobytes())
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array([file] * n), pa.array(range(ordinal, ordinal + n), pa.int64())], ["doc_id", "file", "ordinal"]
                    )
                    ordinal += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary"))
    return cut(rows.mapInArrow(lean(run), f"doc_id {kind}, file string, ordinal long"))


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _open(file)
                size = fs.get_file_info(path).size
                for at in range(0, size, 1024 * block):
                    starts = list(range(at, min(size, at + 1024 * block), block))
                    ends = [min(size, s + block) for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["file", "start", "end"])

    return run


def _separators(file: str, start: int, end: int, sep: int) -> np.ndarray:
    """Places of separators, in ids from the file's start."""
    fs, path = _open(file)
    with fs.open_input_file(path) as f:
        ids = np.frombuffer(f.read_at(end - start, start), "<u2")
    return np.flatnonzero(ids == sep) + start // WIDTH


def _summaries(sep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = _separators(r["file"], r["start"], r["end"], sep)
                r |= {"n": len(p), "last": int(p[-1]) if len(p) else None}
                yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("last", pa.int64())]))

    return run


def _counts(sep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = _separators(r["file"], r["start"], r["end"], sep)
                if r["final"] and (p[-1] if len(p) else r["before"]) < r["end"] // WIDTH - 1:
                    p = np.append(p, r["end"] // WIDTH)  # tokens after the last separator
                n = np.diff(p, prepend=r["before"]) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * len(n), pa.string()), pa.array(np.arange(len(n)) + r["first"], pa.int64()), pa.array(n, pa.int64())],
                    ["file", "ordinal", "n_tokens"],
                )

    return run


def count_tokens(files: DataFrame, separator: int = END, block: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens of every document in the token files named in files (file)."""
    if block % WIDTH:
        raise ValueError("a block holds whole ids")
    spread = files.select("file").mapInArrow(_blocks(block), "file string, start long, end long")
    # many files of few blocks: AQE would join these tiny rows into one task, an explicit number doesn't
    parts = files.sparkSession.sparkContext.defaultParallelism * 4
    seen = cut(spread.repartition(parts, "file", "start").mapInArrow(_summaries(separator), "file string, start long, end long, n long, last long"))
    w = Window.partitionBy("file").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ready = seen.select(
        "file", "start", "end",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("before"),
        F.lead("start").over(w).isNull().alias("final"),
    )
    return ready.repartition(parts, "file", "start").mapInArrow(_counts(separator), "file string, ordinal long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat token files into the shared folder, then counts by scanning them."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    written = write_tokens(table(spark, sf_dir, "documents"), folder)
    counts = cut(count_tokens(written.select("file").distinct()))
    fs.delete_dir(path)
    return written.join(counts, ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
