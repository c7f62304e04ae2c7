"""Mailboxes as DataFrames, split in parallel by byte range.

A range owns the separators that start in it and reads on to the next one. A first pass counts separators
per range in the mapped file, copying nothing, a prefix sum over the ranges numbers them, and a second pass
emits the messages with their ordinal, so no message is ever shuffled and a mailbox of any size is many
tasks. Compressed mailboxes are one range, which is decoded as a stream.
"""

from __future__ import annotations

import gzip
import io
import mmap
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maillake.options import CompressionError, ReadError
from maillake.schemas import MESSAGES

SPLIT, CHUNK = 64 << 20, 1 << 20
#: A separator: From, sender, asctime date (zone before the year, anything after it), end of line.
_CLOCK = rb"\d\d? +\d\d?:\d\d(:\d\d)?"
_ZONE = rb"( +([A-Z]{1,5}|[-+]\d{4}))?"
SEPARATOR = re.compile(rb"^From \S* +[A-Z][a-z][a-z] +[A-Z][a-z][a-z] +" + _CLOCK + _ZONE + rb" +\d{4}( [^\n\r]*)?\r?\n", re.M)
QUOTED = re.compile(rb"(?m)^>(?=>*From )")
MAGIC = {"zstd": b"\x28\xb5\x2f\xfd", "gzip": b"\x1f\x8b"}
SUFFIX = {".zst": "zstd", ".gz": "gzip"}


def unescape(raw: bytes) -> bytes:
    """Take one `>` off lines of `>`s and `From `."""
    return QUOTED.sub(b"", raw) if b">From " in raw else raw


def compression_of(path: str | Path) -> str | None:
    """By the first bytes, so the name may be wrong."""
    head = Path(path).open("rb").read(4)
    return next((k for k, m in MAGIC.items() if head.startswith(m)), None)


def _frames(path: Path) -> int:
    """Frames of a zstd file, found by walking over block headers; raises where the file ends too early."""
    size, frames = path.stat().st_size, 0
    with open(path, "rb") as f:
        while f.tell() < size:
            if f.read(4) != MAGIC["zstd"]:
                raise CompressionError(f"{path}: bytes after the last frame are no frame")
            flags = f.read(1)[0]
            single = flags >> 5 & 1
            f.seek((not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6]), 1)
            while True:
                h = f.read(3)
                if len(h) < 3:
                    raise CompressionError(f"{path} ends inside a frame")
                h = int.from_bytes(h, "little")
                if h >> 1 & 3 == 3:
                    raise CompressionError(f"{path} has a block of reserved type")
                f.seek(1 if h >> 1 & 3 == 1 else h >> 3, 1)
                if h & 1:
                    break
            f.seek(4 * (flags >> 2 & 1), 1)
            if f.tell() > size:
                raise CompressionError(f"{path} ends inside a frame")
            frames += 1
    return frames


def check(path: str | Path, strict: bool = False) -> tuple[int, str | None]:
    """(size, compression) of a readable mailbox; `strict` refuses several frames or members."""
    path = Path(path)
    if not path.is_file():
        raise ReadError(f"there is no file {path}")
    kind = compression_of(path)
    named = SUFFIX.get(path.suffix.lower())
    if named and kind is None and path.stat().st_size:
        raise ReadError(f"{path} is named {path.suffix} but isn't compressed")
    try:
        if kind == "zstd" and _frames(path) > 1 and strict:
            raise CompressionError(f"{path} has several zstd frames")
        if kind == "gzip" and strict and _members(path) > 1:
            raise CompressionError(f"{path} has several gzip members")
    except (CompressionError, IndexError, OSError, EOFError) as e:
        raise ReadError(str(e)) from e
    return path.stat().st_size, kind


def _members(path: Path) -> int:
    import zlib

    members, z = 0, None
    with open(path, "rb") as f:
        data = f.read(CHUNK)
        while data:
            z = z or zlib.decompressobj(31)
            z.decompress(data)
            if z.eof:
                members, data, z = members + 1, z.unused_data.lstrip(b"\0"), None
                data = data or f.read(CHUNK)
            else:
                data = f.read(CHUNK)
    return members


def open_plain(path: str | Path, kind: str | None) -> io.BufferedIOBase:
    """The decoded bytes of a mailbox as a stream."""
    if kind == "gzip":
        return gzip.open(path, "rb")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True, closefd=True)
    return open(path, "rb")


def _blank_before(data: bytes, at: int, start: bool, line: bool) -> bool:
    """Whether an empty line, or the start of the file, comes before place `at`.

    `start`: data begins the file; `line`: data begins at the start of a line.
    """
    if at == 0:
        return start
    before = data[max(0, at - 3) : at]
    return before.endswith((b"\n\n", b"\n\r\n")) or (line and before.lstrip(b"\r") == b"\n" and len(before) < 3)


class _Window:
    """A growing view of a stream from `base` on, three bytes of look-behind included."""

    def __init__(self, stream, base: int):
        self.stream, self.base, self.data, self.over = stream, base, b"", False

    def grow(self) -> bool:
        more = b"" if self.over else self.stream.read(max(CHUNK, len(self.data)))
        self.over = not more
        self.data += more
        return bool(more)


def messages_in(stream, first: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, raw) of the messages whose separator starts in [first, stop), the preamble counting as place 0."""
    base = max(0, first - 3)
    if base:
        stream.seek(base)
    w = _Window(stream, base)
    open_at: int | None = 0 if first == 0 else None  # where the current message's bytes begin
    place, scan, before_any, line = 0, 0, first == 0, base == 0
    while True:
        hit = None
        for m in SEPARATOR.finditer(w.data, scan):
            if w.base + m.start() >= first and _blank_before(w.data, m.start(), w.base == 0, line):
                hit = m
                break
            scan = m.start() + 1
        if hit is None:
            # a separator may be cut off at the end: look again from the last line that isn't whole
            scan = max(scan, w.data.rfind(b"\n") + 1)
            if open_at is None and stop is not None and w.base + scan >= stop:
                return
            if w.grow():
                continue
            if open_at is not None and w.data[open_at:]:
                yield place, w.data[open_at:]
            return
        begin, end = hit.span()
        if open_at is not None and (not before_any or begin > 0):
            yield place, w.data[open_at:begin]
        before_any = False
        if stop is not None and w.base + begin >= stop:
            return
        place = w.base + begin
        # drop what has been emitted; what is left begins a line
        line = True
        w.data, w.base, open_at, scan = w.data[end:], w.base + end, 0, 0


def separators(data, first: int = 0, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """(begin, end) of the separators of bytes or a mapped file that start from place `first` on, before `stop` if given."""
    stop = len(data) if stop is None else stop
    at = first if first == 0 or data[first - 1 : first] == b"\n" else data.find(b"\nFrom ", first, stop + 5) + 1
    while at or first == 0:
        if at < stop and data[at : at + 5] == b"From ":
            m = SEPARATOR.match(data, at)
            if m and _blank_before(data, at, True, True):
                yield m.span()
        first, at = 1, data.find(b"\nFrom ", at, stop + 5) + 1


def messages_of(data, first: int, stop: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the messages whose separator starts in [first, stop), what comes before the first one counting as one."""
    if first and next(separators(data, first, stop), None) is None:
        return  # so a range inside one huge message isn't read beyond its end
    open_at = 0 if first == 0 else None
    for begin, end in separators(data, first):
        if open_at is not None and (open_at or begin):
            yield open_at, begin
        if begin >= stop:
            return
        open_at = end
    if open_at is not None and open_at < len(data):
        yield open_at, len(data)


def _mapped(path: str):
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def split(data: bytes) -> list[bytes]:
    """All messages of a mailbox held in memory."""
    return [raw for _, raw in messages_in(io.BytesIO(data), 0, None)]


def _raws(path: str, kind: str | None, first: int, stop: int) -> Iterator[bytes]:
    if kind:
        with open_plain(path, kind) as f:
            yield from (raw for _, raw in messages_in(f, 0, None))
        return
    with _mapped(path) as data:
        for begin, end in messages_of(data, first, stop):
            yield data[begin:end]


def _scan(unescape_from: bool, kinds: dict[str, str | None], places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple[int, bytes]] = []
                size, ordinal, start = 0, r["before"], r["start"] if places else None
                drop = set(r["drop"] or ())
                if 0 <= r["most"] <= ordinal:
                    continue
                for raw in _raws(r["path"], kinds[r["path"]], r["start"], r["stop"]):
                    ordinal += 1
                    if ordinal not in drop:
                        rows.append((ordinal, unescape(raw) if unescape_from else raw))
                        size += len(raw)
                    if size >= 4 << 20 or len(rows) >= 4096:
                        yield _batch(r["path"], rows, start)
                        rows, size = [], 0
                    if ordinal == r["most"]:
                        break
                if rows:
                    yield _batch(r["path"], rows, start)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _mapped(r["path"]) as data:
                yield pa.RecordBatch.from_pylist([r | {"n": sum(1 for _ in messages_of(data, r["start"], r["stop"]))}])


def bytes_read(spark: SparkSession, path: str | Path, limit: int | None) -> int:
    """How many bytes of a mailbox its first `limit` messages take, all of it without a limit."""
    size, kind = check(path)
    if not limit or kind or not size:
        return size
    with _mapped(str(path)) as data:
        for n, (_, end) in enumerate(messages_of(data, 0, size), 1):
            if n == limit:
                return end
    return size


def _batch(path: str, rows: list[tuple[int, bytes]], start: int | None = None) -> pa.RecordBatch:
    ordinals, raws = zip(*rows)
    # one copy of all bytes; an array of objects would be looked at one by one
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, raws), np.int32, len(rows)), out=offsets[1:])
    raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(raws))])
    cols = {"file": pa.array([path] * len(rows)), "ordinal": pa.array(ordinals, pa.int64()), "raw": raw}
    if start is not None:
        cols["start"] = pa.array([start] * len(rows), pa.int64())
    return pa.RecordBatch.from_pydict(cols)


def iter_messages(path: str | Path, *, unescape_from: bool = True) -> Iterator[bytes]:
    """The raw messages of one mailbox, one after another, in this process."""
    size, kind = check(path)
    for raw in _raws(str(path), kind, 0, size) if size else ():
        yield unescape(raw) if unescape_from else raw


def read_mbox(spark: SparkSession, path, *, unescape_from: bool = True, limit: int | None = None, split_bytes: int = SPLIT, strict: bool = False, places: bool = False, drop: DataFrame | None = None) -> DataFrame:
    """(file, ordinal, raw) of one mailbox or several, which executors must be able to open by path.

    The raw message has neither separator; ordinals count from 1 in each file. `limit` keeps the first N
    of each file. Several zstd frames or gzip members are read unless `strict`. With `places` each row has the
    `start` of its range; rows (file, start, ordinal) of `drop` are passed over by the task that reads the range.
    """
    paths = [str(p) for p in ([path] if isinstance(path, (str, Path)) else path)]
    kinds, ranges = {}, []
    for p in paths:
        size, kinds[p] = check(p, strict)
        if kinds[p]:
            ranges.append((p, 0, -1))
        else:
            ranges += [(p, at, at + split_bytes) for at in range(0, size, split_bytes)]  # an empty file has none
    if not ranges:
        return spark.createDataFrame([], MESSAGES + (", start bigint" if places else ""))
    # a range a task: rows of one partition are dealt out in turn
    plan = spark.createDataFrame(ranges, "path string, start bigint, stop bigint").coalesce(1).repartition(len(ranges))
    before = F.lit(0).cast("long")
    if len(ranges) > len(paths):  # numbers run on from range to range
        w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        counted = plan.where("stop > 0").mapInArrow(_counted, "path string, start bigint, stop bigint, n bigint")
        numbered = counted.withColumn("before", F.coalesce(F.sum("n").over(w), before)).drop("n")
        plan = numbered.unionByName(plan.where("stop < 0").withColumn("before", before)).coalesce(1).repartition(len(ranges))
    else:
        plan = plan.withColumn("before", before)
    plan = plan.withColumn("most", F.lit(limit or -1).cast("long"))
    if drop is None:
        plan = plan.withColumn("drop", F.lit(None).cast("array<bigint>"))
    else:  # a list a range, which a range's size bounds
        lists = drop.groupBy(F.col("file").alias("path"), "start").agg(F.collect_set("ordinal").alias("drop"))
        plan = plan.join(lists, ["path", "start"], "left").coalesce(1).repartition(len(ranges))
    return plan.mapInArrow(_scan(unescape_from, kinds, places), MESSAGES + (", start bigint" if places else ""))
