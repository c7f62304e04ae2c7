"""SimHash near-dedup by anchor-point covering.

A fingerprint is split into two halves of 32 bits. Of two fingerprints that differ in 3 bits or fewer,
one half differs in at most 1. The anchors of a half are the words of the covering code [31,26] Hamming
+ 1 free bit: its covering radius is 1, so every half has a home anchor within 1 bit, and the other
fingerprint's half lies within 1 + 1 = 2 bits of that anchor. Each distinct fingerprint is replicated
to all anchors within 2 bits (at most 17 a half) and compared, per anchor, with those at home there;
that is an equi-join with the exact test inside it, so the work is spread by anchor and no pair that
isn't a link leaves the join. (Over the undivided 64 bits the same code would ask for some 10,000
anchors a fingerprint.)

Equal fingerprints are collapsed first; a group of copies of any size is one row from then on. Hot
anchors are split by AQE's skew join.

Defined cases: null and blank texts have fingerprint zero and link like any other; one or two words
are one shingle; repeated rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.llm.common import ROW, TWIN, components, cut, lean, row_key, slices, table, with_group, without

SHINGLE, SEED, DISTANCE = 3, 42, 3
_BLOCK = 1 << 15
#: Positions 1 to 31 of the Hamming code by bit.
_UNIT = (np.uint64(1) << np.arange(31, dtype=np.uint64)).astype(np.uint64)
#: By syndrome, the 15 pairs of bits that have it.
_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(32)]
_PAIR_MASKS = np.array(
    [[(1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS[s]][:15] if s else [0] * 15 for s in range(32)], np.uint64
)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(i + _BLOCK, n)], last[i : i + _BLOCK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.nonzero(counts * 2 > n)[0].tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch):
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", ROW, "fp"])


def anchors(halves: np.ndarray) -> np.ndarray:
    """Per half (uint64 below 2^32) the home anchor and the 16 others within 2 bits, as (n, 17); repeats may occur."""
    low, top = halves & np.uint64(0x7FFFFFFF), halves & np.uint64(0x80000000)
    s = np.zeros(len(halves), np.uint64)
    for k in range(31):
        s ^= np.where(low >> np.uint64(k) & np.uint64(1), np.uint64(k + 1), np.uint64(0))
    home = np.where(s > 0, low ^ _UNIT[np.maximum(s, 1).astype(np.int64) - 1], low)
    out = np.empty((len(halves), 17), np.uint64)
    out[:, 0] = home | top
    out[:, 1] = home | (top ^ np.uint64(0x80000000))
    near = low[:, None] ^ _PAIR_MASKS[s.astype(np.int64)]
    out[:, 2:] = np.where((s > 0)[:, None], near, home[:, None]) | top[:, None]
    return out


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
            rep = batch.column(1).slice(at, 8192).to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            for half in (0, 1):
                a = anchors(u >> np.uint64(32) if half else u & np.uint64(0xFFFFFFFF))
                key = (a | np.uint64(half << 32)).view(np.int64)
                fresh = np.ones(key.shape, bool)
                fresh[:, 2:] = key[:, 2:] != key[:, :1]  # a half that is a code word has no others
                rows = np.nonzero(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows]), pa.array(fp[rows[0]]), pa.array(rep[rows[0]]), pa.array(rows[1] == 0)],
                    ["anchor", "fp", "rep", "home"],
                )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ROW (row_key()), fp (the 64 bits as a long) of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("binary"))
    return rows.mapInArrow(lean(_fingerprints), f"doc_id long, {ROW} long, fp long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links between distinct fingerprints (fp, rep): a, b are representatives, every pair once."""
    if distance > 3:
        raise ValueError("two halves cover at most 3 differing bits")
    spread = prints.select("fp", "rep").mapInArrow(lean(_replicas), "anchor long, fp long, rep long, home boolean")
    x = spread.where("home").select("anchor", F.col("fp").alias("x"), F.col("rep").alias("a"))
    y = spread.select("anchor", F.col("fp").alias("y"), F.col("rep").alias("b"))
    test = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    return x.join(y, "anchor").where(test).select("a", "b").distinct()


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, ROW, fp, component_id, stays: whether the row is the one of its component that stays."""
    prints = cut(fingerprints(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(ROW).alias("row")))  # null ids come last
    distinct = cut(prints.groupBy("fp").agg(least.alias("best"), F.count("*").alias("n")))
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")))).toDF("node", "label")
    own = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.col("n").alias("rows"), "best", "label")
    linked = own.where("label is not null")
    chosen = linked.groupBy("label").agg(F.count("*").alias("n"), F.min("best").alias("chosen"))
    alone = own.where("label is null").select("fp", F.col("rows").alias("n"), F.col("best").alias("chosen"))
    classes = with_group(linked, chosen, "label", distinct.count()).select("fp", F.col("rows").alias("n"), "chosen").union(alone)
    rows = with_group(prints, classes, "fp", prints.count())
    stays = (F.col(ROW) == F.col("chosen.row")) & F.col("doc_id").eqNullSafe(F.col("chosen.doc_id"))
    return rows.select("doc_id", ROW, "fp", F.col("chosen.doc_id").alias("component_id"), stays.alias("stays"))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    return _classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns kept: of each component the smallest doc_id (null last), one row of it."""
    rows = _classes(docs)
    twins = rows.where("stays").groupBy("doc_id", ROW).agg((F.count("*") > 1).alias(TWIN)).where(TWIN)
    gone = rows.where("not stays").select("doc_id", ROW, F.lit(False).alias(TWIN)).distinct()
    return without(docs, gone.union(twins))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
