"""What the operators share: package shipping, checkpoints and graph components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maillake.ship import SLICE, ship, slices  # noqa: F401  (part of this module for the operators)

#: The white space of the contracts, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"


_KEPT: dict = {}


def kept(key, make):
    """State that a Python worker keeps between the batches of a task: one model at a time, dropped by lean() at its end."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def trim() -> None:
    """Give free pages of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _release() -> None:
    """Drop what this worker keeps, so that idle workers of many stages stay small."""
    _KEPT.clear()
    trim()


def lean(run: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow that leaves nothing behind in the worker when its task ends."""

    @wraps(run)
    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return by_batch


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="maillake-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: a cut for rows that compress well."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of an id bitmap: 1 MB at least, 32 MB at most, whatever the input.
BITS, MOST_BITS, _CHUNK = 1 << 23, 1 << 28, 32768


def bits_for(n: int) -> int:
    """Bits at which a bitmap of n ids is sparse, within the bounds; beyond some 10^8 ids it tells ever less, but never wrong."""
    return min(MOST_BITS, max(BITS, 1 << (16 * n - 1).bit_length() if n else BITS))


def id_position(key: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def id_bitmap(positions: DataFrame) -> DataFrame:
    """(bucket, bits) of a column pos: a row of 4 KB for each 32768 bits in use, so bounded by MOST_BITS."""
    return positions.groupBy(F.floor(F.col("pos") / _CHUNK).alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos") % _CHUNK).alias("bits"))


#: Columns that helpers add; a name that no table uses.
HIT, KEY, ROW, TWIN, _ROW, _POS, _BUCKET, _BITS = (f"__maillake_{x}" for x in ("hit", "key", "row", "twin", "row2", "pos", "bucket", "bits"))


def with_hit(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """Add a column HIT: false only where no id of the bitmap equals key."""
    pos = id_position(key, bits)
    rows = rows.withColumns({_POS: pos, _BUCKET: F.floor(pos / _CHUNK)}).join(F.broadcast(bitmap.toDF(_BUCKET, _BITS)), _BUCKET, "left")
    byte = F.conv(F.hex(F.substr(_BITS, (F.col(_POS) % _CHUNK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col(_POS) % 8).cast("int")).bitwiseAND(1)
    return rows.withColumn(HIT, F.coalesce(bit == 1, F.lit(False))).drop(_POS, _BUCKET, _BITS)


def row_key() -> Column:
    """What tells rows apart where doc_id is null or repeats: a hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def without(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs but those that named (doc_id, ROW: row_key(), TWIN) names; of rows it names as twins one stays.

    Ids compare null-safe, and only rows that may be named are moved; the others stay where they are.
    """
    named = cut(named.select(F.col("doc_id").cast("long").alias(KEY), F.col(ROW).alias(_ROW), TWIN))
    bits = bits_for(named.count())
    rows = with_hit(docs.withColumn(ROW, row_key()), F.col(ROW), id_bitmap(named.select(id_position(F.col(_ROW), bits).alias("pos"))), bits)
    met = rows.where(F.col(HIT)).join(named, (F.col(ROW) == F.col(_ROW)) & F.col("doc_id").cast("long").eqNullSafe(F.col(KEY)), "left")
    names = docs.columns
    out = rows.where(~F.col(HIT)).select(names).union(met.where(F.col(TWIN).isNull()).select(names))
    return out.union(met.where(F.col(TWIN)).dropDuplicates(["doc_id", ROW]).select(names))


#: A group is hot where it holds more than 1 / HOT of all rows; so there are HOT of them at most.
HOT = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of groups (key, n: its number of rows, ...), a row a key, as a left join.

    Hot groups are broadcast, so that their rows stay where they are; the others meet by key.
    """
    groups = groups.withColumnRenamed(key, KEY)
    hot = F.col("n") * HOT > total
    near = rows.join(F.broadcast(groups.where(hot)), F.col(key) == F.col(KEY), "left")
    rest = near.where(F.col(KEY).isNull()).select(rows.columns).join(groups.where(~hot), F.col(key) == F.col(KEY), "left")
    return near.where(F.col(KEY).isNotNull()).unionByName(rest).drop(KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component the smallest node that links reach.

    Alternates large-star and small-star steps, each a min-aggregation and an equi-join, so no
    neighbourhood is ever held in one task; hot nodes are left to AQE's skew join. Only nodes with
    a link to another node appear. Null ends and self links are ignored; no edges give an empty result.
    """
    now = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", "m"))
        now = cut(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
