"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the basis of their principal directions, largest
first. A pair's product over the leading dimensions plus the product of the two norms over the rest
bounds its cosine from above. A block of pairs goes on, a few dimensions at a time, with the rows and
columns that still have a pair within reach, and stops when it has none. The cosine of the vectors as
they came, in double precision, has the last word on pairs that the turned ones leave near the threshold.

Vectors are cut into tiles along the first principal coordinate. Tiles further apart there than linked
vectors can be are never paired; a bucket that holds too many rows is split by hash, so a task holds two
tiles of bounded size. A tile pair returns link counts by row and a spanning forest of its links, so a
dense group never leaves as all its pairs. Equal vectors are collapsed before anything is compared, and
rows find their class by a 128-bit hash, so that no vector is moved for it.

Fitting the basis and the tile edges reads at most `SAMPLE` vectors, those of least hash; it decides speed
alone. Every pair of tiles in reach is compared, so recall is 1; where the first coordinate doesn't tell
vectors apart the work grows with the square of the distinct vectors.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components have no links;
shorter vectors count as padded with zeros; equal rows link with each other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.llm.common import components, cut, lean, table, with_group

THRESHOLD, TILE, SAMPLE, LEAD, ROWS, NEAR = 0.95, 12288, 4096, 16, 1024, 1e-9


def _usable():
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width).astype(float)
    out = np.zeros((len(n), width))
    at = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(n)):
        out[i, : n[i]] = flat[at[i] : at[i + 1]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # against overflow of squares
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def basis(x: np.ndarray) -> np.ndarray:
    """Columns are principal directions of unit vectors, largest first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


class Forest:
    """Components of pairs that arrive in blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            i, j, low, high = i[open_], j[open_], low[open_], high[open_]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]


def _close(part: np.ndarray, x: np.ndarray, y: np.ndarray, tails: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block that the bound never ruled out, and their products; part marks those that it may hold."""
    rows, cols = np.arange(len(x)), np.arange(len(y))
    got, done = np.zeros(part.shape), 0
    for k, tx, ty in tails:
        i, j = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
        if not len(i):
            break
        if len(i) < len(rows) or len(j) < len(cols):
            rows, cols, got, part = rows[i], cols[j], got[np.ix_(i, j)], part[np.ix_(i, j)]
        got += x[rows, done:k] @ y[cols, done:k].T
        done = k
        part = part & (got + (np.outer(tx[rows], ty[cols]) + NEAR) >= threshold)
    i, j = np.nonzero(part)
    return rows[i], cols[j], got[i, j]


def linked(x: np.ndarray, y: np.ndarray | None, turn: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of linked pairs of unit vectors, x with y, or x with itself, each pair once."""
    own = y is None
    y = x if own else y
    d = x.shape[1]
    u, v = x @ turn, y @ turn
    steps = [*range(LEAD, d, LEAD), d]
    tails = [(k, np.sqrt((u[:, k:] ** 2).sum(1)), np.sqrt((v[:, k:] ** 2).sum(1))) for k in steps]
    # the leading dimensions and the rest's norm in single precision first, with room for its rounding
    k, tx, ty = tails[0]
    left = np.hstack([u[:, :k], tx[:, None]]).astype(np.float32)
    right = np.hstack([v[:, :k], ty[:, None]]).astype(np.float32).T.copy()
    for at in range(0, len(u), ROWS):
        for to in range(at if own else 0, len(v), ROWS):
            part = left[at : at + ROWS] @ right[:, to : to + ROWS] >= np.float32(threshold - 1e-5)
            if own and to == at:
                part = np.triu(part, 1)
            cut = [(k, p[at : at + ROWS], q[to : to + ROWS]) for k, p, q in tails]
            i, j, got = _close(part, u[at : at + ROWS], v[to : to + ROWS], cut, threshold)
            i, j = i + at, j + to
            near = np.flatnonzero(np.abs(got - threshold) < 2 * NEAR)
            for b in range(0, len(near), 1 << 16):
                some = near[b : b + (1 << 16)]
                got[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]])
            good = got >= threshold
            yield i[good], j[good]


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    hashed = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", _usable().alias("good"))
    good = rows.where("good").withColumn("key", hashed)
    best = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")).alias("best")  # null ids come last
    kinds = good.groupBy("key").agg(F.any_value("embedding").alias("embedding"), best, F.count("*").alias("n"))
    kinds = cut(kinds.withColumn("rep", F.monotonically_increasing_id()))  # the written rows have these ids for good
    count, width = kinds.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not count:
        return vectors.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = kinds.orderBy("key").limit(SAMPLE).select("embedding").toArrow()
    unit = _unit(_matrix(sample.column(0), width))
    turn = basis(unit)
    buckets = -(-count // tile)
    edges = np.quantile(unit @ turn[:, 0], np.arange(1, buckets) / buckets) if buckets > 1 else np.zeros(0)
    reach = np.sqrt(2 - 2 * threshold) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            b = np.searchsorted(edges, _unit(_matrix(t.column("embedding"), width)) @ turn[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b.astype(np.int32))], ["embedding", "rep", "n", "bucket"])

    kind = kinds.schema["embedding"].dataType.simpleString()
    placed = cut(kinds.select("embedding", "rep", "n").mapInArrow(lean(place), f"embedding {kind}, rep long, n long, bucket int"))
    sizes = dict(placed.groupBy("bucket").agg(F.count("*")).collect())  # a row per tile
    split = np.array([-(-sizes.get(b, 0) // (2 * tile)) or 1 for b in range(buckets)])
    first = np.concatenate([[0], np.cumsum(split)])
    bucket_of = np.repeat(np.arange(buckets), split)
    # the last tile in reach of each tile: the next buckets whose lower edge is near enough to the upper edge
    upper = np.append(edges, np.inf)
    last_bucket = np.array([np.searchsorted(edges, upper[b] + reach, "right") if b < buckets - 1 else b for b in range(buckets)])
    last = first[last_bucket[bucket_of] + 1] - 1
    tiles = int(first[-1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(3).to_numpy()
            rep = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            mixed = (rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = first[b] + (mixed % split[b].astype(np.uint64)).astype(np.int64)
            for t in np.unique(own).tolist():
                part = batch.take(pa.array(np.flatnonzero(own == t)))
                pairs = [(t, j) for j in range(t, last[t] + 1)] + [(i, t) for i in range(t) if last[i] >= t]
                for i, j in pairs:
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i * tiles + j] * n, pa.int64()), pa.array([j == t and i != t] * n), *part.columns[:3]],
                        ["pair", "right", "embedding", "rep", "n"],
                    )

    def compare(t: pa.Table) -> pa.Table:
        side = t.column("right").to_numpy()
        own = not side.any() and t.column("pair")[0].as_py() % (tiles + 1) == 0
        x = _unit(_matrix(t.column("embedding"), width))
        order = np.argsort(side, kind="stable")
        cutoff = int((~side).sum())
        ids = t.column("rep").to_numpy()[order]
        n = t.column("n").to_numpy()[order]
        x = x[order]
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        a, b = (x, None) if own else (x[:cutoff], x[cutoff:])
        for i, j in linked(a, b, turn, threshold) if len(a) and (own or len(b)) else ():
            j = j if own else j + cutoff
            links += np.bincount(i, n[j], len(ids)).astype(np.int64) + np.bincount(j, n[i], len(ids)).astype(np.int64)
            forest.add(i, j)
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[hit], pa.int64()), "root": pa.array(ids[forest.root[hit]], pa.int64()), "links": pa.array(links[hit], pa.int64())})

    pairs = placed.mapInArrow(lean(spread), f"pair long, right boolean, embedding {kind}, rep long, n long")
    found = cut(pairs.groupBy("pair").applyInArrow(compare, "rep long, root long, links long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    own = kinds.select("key", F.col("n").alias("rows"), "best", "rep").join(sums, "rep", "left").join(parts.toDF("rep", "label"), "rep", "left")
    own = own.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("rows") - 1)
    many = own.where("label is not null")
    chosen = many.groupBy("label").agg(F.count("*").alias("n"), F.min("best").alias("chosen"))
    names = ["key", F.col("rows").alias("n"), "links", F.col("chosen.vec_id").alias("component")]
    alone = own.where("label is null").withColumn("chosen", F.col("best")).select(names)
    classes = with_group(many, chosen, "label", count).select(names).union(alone)
    found = with_group(good.select("vec_id", "key"), classes, "key", good.count()).select("vec_id", "links", "component")
    none = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = found.union(none).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x), c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""
