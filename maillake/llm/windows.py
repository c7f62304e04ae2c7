"""Routing of fixed-length windows, bytes or words, to shards that see all their occurrences.

Of the grams in a window the one of least hash is its minimizer; equal windows have equal minimizers at
equal places. Consecutive windows that share a minimizer form a segment, and the minimizer's hash names
the segment's shard, so equal windows meet there, wherever they lie. The number of shards follows the
input, so a shard's size doesn't; inside a shard, work is cut into parts by minimizer, so shards may be
large and the rows that go to them few.

Texts are cut in blocks, and what blocks send leaves in loads of several of them, so that a row holds what a
load has for a shard; rows grow with loads times shards until each holds one segment. Texts are read twice.
The first time only five bytes of each minimizer's hash are sent, to a count that COUNTED shards share, and it
tells each load which of them occur elsewhere too; each load's answer is a bit a segment, in a file of the
shared folder. The second time only segments whose minimizer recurs leave, each text once a load however
often it occurs, its places small numbers beside it, compressed. The answers only save work: a load that
finds none (because rows came in another order) sends all its segments.

A row is known by its doc_id and a hash of doc_id and text, so that rows of different texts under one
doc_id, or under none, each get marks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from maillake.llm.common import HIT, bits_for, id_bitmap, id_position, lean, row_key, shared_dir, slices, stored, trim, with_hit

NO_ID = (1 << 63) - 1  # stands for a null doc_id: after all others
#: Low bits of a gram's hash that give way to its place in the block. One number for all blocks, so that equal
#: windows break ties alike everywhere; a block has fewer units than this.
PLACE_BITS = np.uint64(24)
#: Bytes of text whose segments leave together; shards whose minimizers are counted together; bytes of blobs in a batch.
LOAD, COUNTED, BATCHED = 16 << 20, 4, 4 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def grams(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` (a power of two) values."""
    n, c = 1, int(_C1)
    while n < size:
        x = x[:-n] * np.uint64(c) + mixed(x[n:]) if len(x) > n else x[:0]
        n, c = 2 * n, c * int(_C2) & (1 << 64) - 1 | 1
    return mixed(x)


def byte_grams(data: bytes, size: int) -> np.ndarray:
    """grams() of bytes; runs of 8 are read as one number."""
    if size % 8 or len(data) < size:
        return grams(mixed(np.frombuffer(data, np.uint8).astype(np.uint64)), size)
    eights = np.empty(len(data) - 7, "<u8")
    for k in range(min(8, len(eights))):
        part = eights[k::8]
        part[:] = np.frombuffer(data, "<u8", len(part), k)
    eights = eights.view(np.uint64)
    n = len(data) - size + 1
    out = eights[:n] * _C1
    for k in range(8, size, 8):
        out ^= out >> np.uint64(32)
        out *= _C2
        out += eights[k : k + n]
    return mixed(out)


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    n = 1
    while 2 * n <= size:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (size - n)], x[size - n :]) if size > n else x


class Units:
    """How a text is cut into the units that windows are made of."""

    def __init__(self, words: bool, window: int, gram: int, block: int, load: int = LOAD):
        self.words, self.window, self.gram, self.block, self.load = words, window, gram, block, load
        self.known: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def segments(self, docs: list[tuple[int, int, int, bytes]]) -> tuple:
        """Segments of a block of docs (doc_id, row, place of the first unit, text): data and arrays."""
        if self.words:
            split = [t.split() for *_, t in docs]
            words = [w for s in split for w in s]
            data = b" ".join(words)
            sizes = np.array([len(s) for s in split])
            length = np.fromiter(map(len, words), np.int64, len(words))
            begin = np.cumsum(length + 1) - length - 1
        else:
            data = b"".join(t for *_, t in docs)
            sizes = np.array([len(t) for *_, t in docs])
            begin, length = np.arange(len(data)), None
        n = len(begin)
        if n < self.window:
            return data, *[np.zeros(0, np.int64)] * 8
        order = grams(self._hash(words), self.gram) if self.words else byte_grams(data, self.gram)
        low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
        if n > int(low):
            raise ValueError("a block is too large")
        packed = (order & ~low) | np.arange(len(order), dtype=np.uint64)
        place = (sliding_least(packed, self.window - self.gram + 1) & low).astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)  # a window is inside one text
        good = np.arange(len(place)) + self.window <= ends[: len(place)]
        place[~good] = -1
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(start, len(place)))
        keep = place[start] >= 0
        start, count = start[keep], count[keep]
        at = place[start]
        doc = np.searchsorted(np.cumsum(sizes), start, "right")
        first = np.cumsum(sizes) - sizes
        last = start + count + self.window - 2
        stop = begin[last] + (length[last] if self.words else 1)
        tail = at + self.gram - 1
        ids, rows, places = (np.array([d[k] for d in docs], np.int64)[doc] for k in range(3))
        where = start - first[doc] + places
        gram_end = begin[tail] + (length[tail] if self.words else 1)
        return data, order[at].view(np.int64), ids, rows, where, count, begin[start], stop, np.stack([begin[at], gram_end])

    def pieces(self, doc_id: int, row: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        """Very long texts in parts that overlap by a window less one unit, so that each window is in one part."""
        if self.words:
            if len(text) <= self.block:
                yield doc_id, row, 0, text
                return
            words = text.split()
            step = max(1, self.block // 8)
            for at in range(0, max(1, len(words) - self.window + 1), step):
                yield doc_id, row, at, b" ".join(words[at : at + step + self.window - 1])
        else:
            for at in range(0, max(1, len(text) - self.window + 1), self.block):
                yield doc_id, row, at, text[at : at + self.block + self.window - 1]


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


_KINDS = ("<i8", "<i8", "<u4", "<u4", "<u4", "<u2", "<u4", "<u4", "u1")


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", n, 4).tolist()
    out, at = [], 4 + 4 * n
    for size, kind in zip(sizes, _KINDS):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _blocks(units: Units, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts (doc_id, row, place, part) in blocks of bounded size."""
    block, size = [], 0
    for batch in batches:
        for part in slices(batch, 256):
            for i, r, t in zip(*(part.column(k).to_pylist() for k in range(3))):
                for piece in units.pieces(NO_ID if i is None else i, r, t or b""):
                    block.append(piece)
                    size += len(piece[3])
                    if size >= units.block:
                        yield block
                        block, size = [], 0
    if block:
        yield block


def _loads(units: Units, batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Blocks in loads of bounded size."""
    load, size = [], 0
    for block in _blocks(units, batches):
        load.append(block)
        size += sum(len(t) for *_, t in block)
        if size >= units.load:
            yield load
            load, size = [], 0
    if load:
        yield load


def _name(load: list[list[tuple[int, int, int, bytes]]]) -> bytes:
    h = xxhash.xxh3_128()
    for block in load:
        for i, _, place, t in block:
            h.update(b"%d %d %d " % (i, place, len(t)))
            h.update(t)
    return h.digest()


def _sorted(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard that is stable, and (shard, start, stop) in it of the shards that occur."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist()
    return order, list(zip(shard[order[edges[:-1]]].tolist(), edges[:-1], edges[1:]))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("binary"))


def _recurring(docs: DataFrame, units: Units, counts: int, folder: str) -> None:
    """Write, for each load, which of its segments have a minimizer that recurs."""
    from pyarrow import fs

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for load in _loads(units, batches):
            u = np.concatenate([units.segments(block)[1] for block in load]).view(np.uint64)
            order, found = _sorted((u % np.uint64(counts)).astype(np.int64))
            five = (u[order] // np.uint64(counts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            keys = [five[5 * a : 5 * b] for _, a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in found], pa.int32()), pa.array([_name(load)] * len(found), pa.binary()), pa.array(keys, pa.binary())], ["count", "load", "keys"])

    def answer(t: pa.Table) -> pa.Table:
        raw = t.column("keys").to_pylist()
        wide = np.zeros((sum(map(len, raw)) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
        keys = wide.view("<u8").ravel()
        # a key recurs if it comes more than once, from one load or several
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        ends = np.cumsum([len(x) // 5 for x in raw]).tolist()
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
        out = pa.table({"load": t.column("load"), "count": t.column("count"), "bits": pa.array(bits, pa.binary())})
        del raw, wide, keys, order, same, again
        trim()
        return out

    def keep(t: pa.Table) -> pa.Table:
        store, root = fs.FileSystem.from_uri(folder)
        rows = dict(sorted(zip(t.column("count").to_pylist(), t.column("bits").to_pylist())))  # loads of equal texts have equal bits
        name = t.column("load")[0].as_py().hex()
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(np.array([len(rows), *rows, *map(len, rows.values())], "<u4").tobytes())
            f.write(b"".join(rows.values()))
        store.move(part, f"{root}/{name}")
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    asked = _rows(docs).mapInArrow(lean(ask), "count int, load binary, keys binary")
    answered = asked.groupBy("count").applyInArrow(answer, "load binary, count int, bits binary")
    answered.groupBy("load").applyInArrow(keep, "n bigint").agg(F.sum("n")).collect()


class _Answers:
    """What the first pass says of a load's segments, taken block by block."""

    def __init__(self, folder: str, load: list[list], counts: int):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/{_name(load).hex()}"
        self.counts, self.flat = counts, None
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return
        with store.open_input_stream(path) as f:
            raw = f.read()
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        which, size = np.frombuffer(raw, "<u4", 2 * n, 4).astype(np.int64).reshape(2, n)
        self.flat = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 8 * n)).astype(bool)
        self.next = np.zeros(counts, np.int64)  # the place of each count's next bit
        self.next[which] = 8 * (np.cumsum(size) - size)

    def of(self, key: np.ndarray) -> np.ndarray:
        """Which of the next block's segments have a minimizer that recurs, as far as is known."""
        if self.flat is None:
            return np.arange(len(key))
        count = (key.view(np.uint64) % np.uint64(self.counts)).astype(np.int64)
        order = np.argsort(count, kind="stable")
        many = np.bincount(count, minlength=self.counts)
        at = np.arange(len(key)) + np.repeat(self.next - (np.cumsum(many) - many), many)
        self.next += many
        return np.sort(order[self.flat[at]])


def spread(docs: DataFrame, units: Units, shards: int) -> tuple[DataFrame, str]:
    """(shard, blob) of docs (doc_id, text): segments whose minimizer recurs; and the folder of answers that this needs."""
    from pyarrow import fs

    folder = f"{shared_dir(docs.sparkSession)}/recurring-{uuid.uuid4().hex}"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    counts = -(-shards // COUNTED)
    _recurring(docs, units, counts, folder)

    def emit(load: list[list[tuple[int, int, int, bytes]]], press) -> Iterator[pa.RecordBatch]:
        answers = _Answers(folder, load, counts)
        parts, texts, size = [], [], 0
        for block in load:
            data, *cols, gram = units.segments(block)
            some = answers.of(cols[0])
            if len(some):
                key, ids, rows, where, count, begin, stop = (c[some] for c in cols)
                parts.append((key, ids, rows, where, count, begin + size, stop + size, gram[0][some] - begin, gram[1][some] - gram[0][some]))
                texts.append(data)
                size += len(data)
        if not parts:
            return
        data = b"".join(texts)
        order, found = _sorted((np.concatenate([p[0] for p in parts]).view(np.uint64) % np.uint64(shards)).astype(np.int64))
        ids, rows, where, count, begin, stop, lead, length = (np.concatenate(c)[order] for c in list(zip(*parts))[1:])
        del parts, texts
        names, blobs, size = [], [], 0
        for shard, a, b in found:
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(begin[a:b].tolist(), stop[a:b].tolist())])
            one = a + np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))  # where each text comes first
            blobs.append(press.compress(_pack(
                np.diff(ids[a:b], prepend=0).astype("<i8"), np.diff(rows[a:b], prepend=0).astype("<i8"), where[a:b].astype("<u4"), which.astype("<u4"),
                (stop[one] - begin[one]).astype("<u4"), count[one].astype("<u2"), lead[one].astype("<u4"), length[one].astype("<u4"),
                np.frombuffer(b"".join(seen), np.uint8),
            )))
            names.append(shard)
            size += len(blobs[-1])
            if size >= BATCHED or b == len(order):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])
                names, blobs, size = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for load in _loads(units, batches):
            yield from emit(load, press)

    return _rows(docs).mapInArrow(lean(run), "shard int, blob binary"), folder


def by_gram(gram: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Segments in parts of about `most` units; those of one minimizer, which alone can share windows, stay together."""
    order = np.argsort(gram, kind="stable")
    if not len(order):
        return
    total = np.cumsum(size[order]) - size[order]
    first = np.flatnonzero(np.diff(gram[order], prepend=-1))
    part = np.repeat(total[first] // most, np.diff(np.append(first, len(order))))
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


class Shard:
    """The distinct segments of a shard and where they occur."""

    def __init__(self, blobs: list[bytes]):
        unpress = zstandard.ZstdDecompressor()
        seen: dict[bytes, int] = {}
        grams: dict[bytes, int] = {}
        count, gram, docs, rows, places, which = [], [], [], [], [], []
        for blob in blobs:
            d, r, place, index, sizes, n, g, glen, text = _unpack(unpress.decompress(blob))
            raw, ends = text.tobytes(), np.cumsum(sizes).tolist()
            own = []
            for a, b, k, x, y in zip([0, *ends], ends, n.tolist(), g.tolist(), glen.tolist()):
                t = raw[a:b]
                i = seen.get(t)
                if i is None:
                    i = seen[t] = len(seen)
                    count.append(k)
                    gram.append(grams.setdefault(t[x : x + y], len(grams)))
                own.append(i)
            docs.append(np.cumsum(d))
            rows.append(np.cumsum(r))
            places.append(place.astype(np.int64))
            which.append(np.array(own, np.int64)[index])
        self.texts = list(seen)
        self.count, self.gram = np.array(count, np.int64), np.array(gram, np.int64)
        self.doc, self.row, self.place, self.which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, rows, places, which))


def by_shard(blobs: DataFrame, work: Callable[[Shard], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, row, start, stop): the units that `work` marks (index of the occurrence, start, stop), shard by shard."""

    def run(t: pa.Table) -> pa.Table:
        shard = Shard(t.column("blob").to_pylist())
        del t
        which, start, stop = work(shard)
        cols = {"doc_id": shard.doc[which], "row": shard.row[which], "start": start, "stop": stop}
        out = pa.table({k: pa.array(c, pa.int64()) for k, c in cols.items()})
        del shard
        trim()  # a shard's Python objects are many times its size
        return out

    return blobs.groupBy("shard").applyInArrow(run, "doc_id long, row long, start long, stop long")


def shards_for(docs: DataFrame, size: int) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // size))


def finish(docs: DataFrame, marks: DataFrame, folder: str, work: Callable[[bytes, list], tuple], schema: str) -> DataFrame:
    """Apply work(text, marks) to each doc; only the texts that have marks are moved to meet them."""
    from pyarrow import fs

    marks = stored(marks)
    store, root = fs.FileSystem.from_uri(folder)
    store.delete_dir(root)  # the marks are written, so no task asks again
    bits = bits_for(marks.agg(F.approx_count_distinct("row")).first()[0])
    bitmap = id_bitmap(marks.select(id_position(F.col("row"), bits).alias("pos")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = with_hit(docs.select("doc_id", F.col("text").cast("binary").alias("text"), key.alias("_key"), row_key().alias("_row")), F.col("_row"), bitmap, bits)
    # a set: rows that repeat id and text repeat their marks
    lists = marks.groupBy(F.col("doc_id").alias("_key"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    kind = "array<struct<start:bigint,stop:bigint>>"
    touched = rows.where(F.col(HIT)).join(lists, ["_key", "_row"], "left").select("doc_id", "text", F.col("marks").cast(kind))
    others = rows.where(~F.col(HIT)).select("doc_id", "text", F.lit(None).cast(kind).alias("marks"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 256):
                lists = b.column(2)
                flat = np.stack([lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1) if len(lists.flatten()) else np.zeros((0, 2), np.int64)
                size = np.array([0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()])
                ends = np.cumsum(size)
                found = [work(t or b"", flat[e - s : e]) for t, s, e in zip(b.column(1).to_pylist(), size, ends)]
                cols = [pa.array(list(c), pa.string() if "string" in k else pa.int64()) for c, k in zip(zip(*found), schema.split(", "))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = [x.mapInArrow(lean(run), f"doc_id {kind}, {schema}") for x in (touched, others)]
    return parts[0].union(parts[1])


def mask(n: int, marks: np.ndarray) -> np.ndarray:
    """Which of n units the marks cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, marks[:, 0], 1)
    np.add.at(delta, marks[:, 1], -1)
    return np.cumsum(delta[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags."""
    d = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
