"""Compress a mailbox beside itself and prove it by decompressing: a driver utility."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from maillake.options import CompressionError
from maillake.sources.mbox import compression_of, open_plain

EXTENSION = {"gzip": ".gz", "zstd": ".zst"}
_STEP = 1 << 20
AnyPath = str | Path
#: Hears of (phase, bytes done, bytes in all).
Progress = Callable[[str, int, int], None]


@dataclass(frozen=True, kw_only=True)
class CompressResult:
    """A verified copy: what it was made of, how, and its size."""

    algorithm: str
    level: int
    source: Path
    source_bytes: int
    source_deleted: bool = False
    dest: Path
    compressed_bytes: int
    sha256: str

    @property
    def ratio(self) -> float:
        small = self.compressed_bytes
        return self.source_bytes / small if small else 0.0


def _writer(path: Path, algorithm: str, level: int):
    if algorithm == "gzip":
        return gzip.open(path, "wb", compresslevel=min(level, 9))
    import zstandard

    return zstandard.ZstdCompressor(level=2 * level - 1, write_checksum=True).stream_writer(open(path, "wb"), closefd=True)


def compress_mbox(
    source: AnyPath, dest: AnyPath | None = None, *, level: int = 5, algorithm: str = "zstd", overwrite: bool = False,
    delete_source: bool = False, on_progress: Progress | None = None,
) -> CompressResult:
    """Compress at level 1 to 10, read all of it back and compare; only then may the source be deleted."""
    source = Path(source)
    if algorithm not in EXTENSION or not 1 <= level <= 10:
        raise CompressionError(f"no such compression: {algorithm} at level {level}")
    if not source.is_file():
        raise CompressionError(f"there is no file {source}")
    if compression_of(source):
        raise CompressionError(f"{source} is compressed as it is")
    target = Path(dest) if dest else source.parent / (source.name + EXTENSION[algorithm])
    if target.exists() and not overwrite:
        raise CompressionError(f"{target} is there")
    tell = on_progress or (lambda *_: None)
    part = target.parent / f".{target.name}.{uuid.uuid4().hex}.tmp"
    total = source.stat().st_size
    try:
        want = hashlib.sha256()
        with open(source, "rb") as f, _writer(part, algorithm, level) as out:
            while block := f.read(_STEP):
                want.update(block)
                out.write(block)
                tell("compress", f.tell(), total)
        size = part.stat().st_size
        got, n = hashlib.sha256(), 0
        try:
            with open_plain(part, algorithm) as f:
                while block := f.read(_STEP):
                    got.update(block)
                    n += len(block)
                    tell("verify", min(n, total), total)
        except Exception as e:
            raise CompressionError(f"the copy of {source} can't be read back: {e}") from e
        if (n, got.digest()) != (total, want.digest()):
            raise CompressionError(f"the copy of {source} differs from it; the source is as it was")
        part.replace(target)
    finally:
        if part.exists():
            part.unlink()
    if delete_source:
        source.unlink()
    return CompressResult(
        algorithm=algorithm, level=level, source=source, source_bytes=total, source_deleted=delete_source, dest=target, compressed_bytes=size, sha256=want.hexdigest()
    )
