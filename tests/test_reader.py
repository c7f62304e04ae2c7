import gzip
import io
import random
import re

import pytest
import zstandard

from maillake.options import ReadError
from maillake.sources import mbox
from tests import make_fixtures as fx

PIECES = [b"From a@b Mon Jan 15 09:30:00 2024\n", b"From a@b Mon Jan 15 09:30:00 +0000 2024\r\n", b"\n", b"\r\n", b"\r", b"From me\n", b">From x\n", b"text\n", b"text", b"From  Mon Jan  5 9:30 EST 2024 remote\n", b"From "]


def by_lines(data):
    """The splitting rule, line by line."""
    out, now, blank = [], [], True
    for line in re.findall(rb"[^\n]*\n|[^\n]+$", data):
        if blank and re.fullmatch(mbox.SEPARATOR.pattern[1:], line):
            out += [b"".join(now)] if now else []
            now = []
        else:
            now.append(line)
        blank = not line.strip(b"\n") or line == b"\r\n"
    return out + ([b"".join(now)] if now else [])


def test_splitting_equals_the_rule_whatever_the_ranges(monkeypatch):
    monkeypatch.setattr(mbox, "CHUNK", 16)
    rng = random.Random(1)
    for _ in range(3000):
        data = b"".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        want = by_lines(data)
        assert mbox.split(data) == want
        step = rng.randrange(1, 60)
        got = [raw for a in range(0, len(data), step) for _, raw in mbox.messages_in(io.BytesIO(data), a, a + step)]
        assert got == want
        assert [data[b:e] for a in range(0, len(data), step) for b, e in mbox.messages_of(data, a, a + step)] == want


@pytest.mark.parametrize("name", fx.ALL)
@pytest.mark.parametrize("size", [300, 1 << 20])
def test_read_is_the_same_for_any_split(spark, tmp_path, name, size):
    data = fx.ALL[name]()
    path = tmp_path / "x.mbox"
    path.write_bytes(data)
    rows = mbox.read_mbox(spark, path, split_bytes=size).orderBy("ordinal").collect()
    assert [bytes(r.raw) for r in rows] == [mbox.unescape(m) for m in by_lines(data)]
    assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
    assert mbox.read_mbox(spark, path, split_bytes=size, limit=3).count() == min(3, len(rows))
    kept = mbox.read_mbox(spark, path, unescape_from=False, split_bytes=size).orderBy("ordinal").collect()
    assert [bytes(r.raw) for r in kept] == by_lines(data)


def test_unescape():
    assert mbox.unescape(b">From a\n>>From b\n> From c\nx>From d\n") == b"From a\n>From b\n> From c\nx>From d\n"


def test_compressed_and_misnamed_files(spark, tmp_path):
    data = fx.attachments()
    want = [mbox.unescape(m) for m in by_lines(data)]
    z = zstandard.ZstdCompressor(write_checksum=True)
    files = {"a.mbox.gz": gzip.compress(data), "a.mbox.zst": z.compress(data), "plain": gzip.compress(data), "b.mbox": z.compress(data), "two.gz": gzip.compress(data[:3000]) + gzip.compress(data[3000:]), "two.zst": z.compress(data[:3000]) + z.compress(data[3000:])}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
        rows = mbox.read_mbox(spark, tmp_path / name).orderBy("ordinal").collect()
        assert [bytes(r.raw) for r in rows] == want, name
    for name in ("two.gz", "two.zst"):
        with pytest.raises(ReadError):
            mbox.read_mbox(spark, tmp_path / name, strict=True)


def test_refusals(spark, tmp_path):
    with pytest.raises(ReadError):
        mbox.read_mbox(spark, tmp_path / "absent")
    (tmp_path / "text.zst").write_bytes(b"From nobody")
    half = zstandard.compress(fx.filler("x", 300_000) + bytes(range(256)) * 50)
    (tmp_path / "half.zst").write_bytes(half[: len(half) // 2])
    (tmp_path / "junk.zst").write_bytes(b"\x28\xb5\x2f\xfdjunk")
    for name in ("text.zst", "half.zst", "junk.zst"):
        with pytest.raises(ReadError):
            mbox.read_mbox(spark, tmp_path / name)


def test_several_files(spark, tmp_path):
    for name in ("basic", "crlf"):
        (tmp_path / name).write_bytes(fx.ALL[name]())
    rows = mbox.read_mbox(spark, [tmp_path / "basic", tmp_path / "crlf"]).groupBy("file").count().collect()
    assert sorted(r["count"] for r in rows) == [2, 8]
