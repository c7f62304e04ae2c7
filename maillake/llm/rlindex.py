"""Suffix-array dedup of bytes with a run-length index.

Windows of 50 bytes are routed to shards by minimizer (see windows.py). A segment that shares no window with
another text, but comes in several documents, is marked whole in all but the first. Of the other distinct
repeated segments a shard sorts the suffixes, keeps their Burrows-Wheeler transform as runs with the text places
of each run's first and last row as samples, and forgets the suffix array. Segments then stream their matching
statistics from right to left: while the next byte heads the current run the row maps on; otherwise the
nearest runs of that byte offer their sampled rows, and the longer common extension wins. Where 50 bytes
match, the row lies in the class of all suffixes that begin with these 50 bytes, and the class knows the
smallest doc_id they occur in. A window is marked wherever that id is smaller than the document's own.

Defined cases: null text is empty; texts below 50 bytes lose nothing; a window that repeats in its own
document only stays; rows that share a doc_id count as one document, and those without as one, but each
is marked by its own text; a null doc_id counts as larger than any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from maillake.llm.common import table
from maillake.llm.windows import LOAD, Shard, Units, by_gram, by_shard, finish, mask, mixed, runs, shards_for, spread

WINDOW, GRAM, BLOCK, SHARD, INDEX = 50, 16, 2 << 20, 6 << 20, 2 << 20
_PACK = 7  # symbols of 9 bits in one key


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0 of keys."""
    order = np.argsort(key)
    seen = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], seen[1:] != seen[:-1]]))
    return out


class RunIndex:
    """Run-length Burrows-Wheeler index of texts; docs gives the id each text stands for."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, window: int):
        self.window = window
        size = np.array([len(t) + 1 for t in texts])
        n = int(size.sum())
        self.symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(size) - 1
        self.symbols[ends] = 0  # one end mark a text, ordered by place
        self.left = np.repeat(ends, size) - np.arange(n)  # bytes before the end mark
        key = np.zeros(n, np.int64)
        for k in range(_PACK):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = self.symbols[k:]
            shifted[self.left < k] = 0
            key = key << 9 | shifted
        self.key = key
        rank, depth = _dense(key), _PACK
        longest = int(size.max())
        part = (key >> 9 * (_PACK - window), window) if window < _PACK else (rank, depth)
        order = None
        while order is None:
            # three ranks make the next key where they fit, else two
            ways = 3 if n + 1 < 1 << 21 else 2
            wide = np.zeros(n, np.int64)
            for k in range(ways):
                at = np.zeros(n, np.int64)
                if k * depth < n:
                    at[: n - k * depth] = rank[k * depth :] + 1
                at[self.left < k * depth] = 0
                wide = wide * np.int64(n + 1) + at
            if ways * depth >= max(longest, window):  # the last key tells all; equal suffixes go by place
                order = np.argsort(wide, kind="stable")
                continue
            rank, depth = _dense(wide), ways * depth
            if depth <= window:
                part = (rank, depth)
        rank, depth = part
        # classes: neighbours in order that share `window` bytes; overlapping parts tell
        full = self.left[order] >= window
        same = full[1:] & full[:-1]
        for shift in {*range(0, window - depth, depth), max(0, window - depth)}:
            seen = rank[np.where(full, order + shift, 0)]
            same &= seen[1:] == seen[:-1]
        class_start = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(np.repeat(docs, size)[order], class_start)
        self.row_doc = np.repeat(least, np.diff(np.append(class_start, n)))  # by row, as a shard is small
        # runs of the transform
        before = self.symbols[order - 1]
        self.run_start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_char = before[self.run_start]
        length = np.diff(np.append(self.run_start, n))
        self.first_at, self.last_at = order[self.run_start], order[self.run_start + length - 1]
        by_char = np.argsort(self.run_char, kind="stable")
        counts = np.bincount(self.run_char, length, 257).astype(np.int64)
        total = np.cumsum(counts) - counts
        seen = np.cumsum(length[by_char]) - length[by_char]
        self.run_of = np.repeat(np.arange(len(length), dtype=np.int32), length)
        self.lf = np.empty(len(by_char), np.int64)  # row that a run's first row maps to
        self.lf[by_char] = seen  # as the characters before are counted too, this is the place among all rows
        assert (self.lf >= total[self.run_char]).all()
        self.run_length, self.by_char = length, by_char
        self.char_keys = self.run_char[by_char] * len(by_char) + by_char

    def _extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of text places, up to the window at least."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for k in range(0, self.window + _PACK, _PACK):
            going = going[most[going] > k]
            x = self.key[a[going] + k] ^ self.key[b[going] + k]
            equal = x == 0
            part = going[~equal]
            top = np.frexp(x[~equal].astype(float))[1]  # the highest differing bit, good enough to 53 bits
            out[part] = k + _PACK - 1 - (np.maximum(top, 1) - 1) // 9
            going = going[equal]
            out[going] = k + _PACK
        return np.minimum(out, most)

    def matching_statistics(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all places of all texts, in order: (first place of each text, length up to the window, smallest doc where it is the window)."""
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        lanes = np.argsort(-size, kind="stable")
        lengths, docs = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        row, at, n = (np.zeros(len(texts), np.int64) for _ in range(3))
        at[:] = self.first_at[0]
        ascending = -size[lanes]
        r = len(self.run_start)
        for step in range(int(size.max(initial=0))):
            live = lanes[: np.searchsorted(ascending, -step, "left")]
            where = first[live] + size[live] - 1 - step
            c = flat[where]
            run = self.run_of[row[live]].astype(np.int64)
            offset = row[live] - self.run_start[run]
            here = at[live]
            miss = np.flatnonzero(self.run_char[run] != c)
            if len(miss):
                k = np.searchsorted(self.char_keys, c[miss] * r + run[miss])
                up, down = self.by_char[np.maximum(k - 1, 0)], self.by_char[np.minimum(k, r - 1)]
                has_up, has_down = (k > 0) & (self.run_char[up] == c[miss]), (k < r) & (self.run_char[down] == c[miss])
                ext_up = np.where(has_up, self._extension(here[miss], self.last_at[up]), -1)
                ext_down = np.where(has_down, self._extension(here[miss], self.first_at[down]), -1)
                take = ext_down > ext_up
                run[miss] = np.where(take, down, up)
                offset[miss] = np.where(take, 0, self.run_length[run[miss]] - 1)
                here[miss] = np.where(take, self.first_at[down], self.last_at[up])
                best = np.maximum(ext_up, ext_down)
                n[live[miss]] = np.minimum(n[live[miss]], best)  # -1: the byte occurs nowhere
            lost = n[live] < 0
            row[live] = np.where(lost, 0, self.lf[run] + offset)
            at[live] = np.where(lost, self.first_at[0], here - 1)
            n[live] = np.minimum(n[live] + 1, self.window)
            lengths[where] = n[live]
            whole = n[live] >= self.window
            docs[where[whole]] = self.row_doc[row[live[whole]]]
        return first, lengths, docs


def _shared(texts: list[bytes], least: np.ndarray, most: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may have a window that two docs have, and which may have one of another text: tests of window hashes, which spare the index the rest."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    power = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    inverse = np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(np.arange(256, dtype=np.uint64) + np.uint64(7))[data] * power[:n])])
    count = size - window + 1
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + inner
    h = mixed((total[at + window] - total[at]) * inverse[at])
    order = np.argsort(h)
    start = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    of = np.repeat(np.arange(len(texts)), count)[order]
    two = np.minimum.reduceat(least[of], start) < np.maximum.reduceat(most[of], start)
    two_texts = two & (np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start))
    docs, others = np.zeros((2, len(texts)), bool)
    times = np.diff(np.append(start, len(h)))
    docs[of[np.repeat(two, times)]] = True
    others[of[np.repeat(two_texts, times)]] = True
    return docs, others


def locate(shard: Shard, window: int, index: int = INDEX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (index of the occurrence, start, stop in bytes) of windows that a smaller doc_id has too; about `index` bytes are indexed at once."""
    out = [(np.zeros(0, np.int64),) * 3]
    if not len(shard.which):
        return out[0]
    least = np.full(shard.gram.max() + 1, np.iinfo(np.int64).max)
    most = np.full(len(least), -1 << 62)
    np.minimum.at(least, shard.gram[shard.which], shard.doc)
    np.maximum.at(most, shard.gram[shard.which], shard.doc)
    chosen = np.flatnonzero((least < most)[shard.gram])
    own, top = np.full(len(shard.texts), np.iinfo(np.int64).max), np.full(len(shard.texts), -1 << 62)
    np.minimum.at(own, shard.which, shard.doc)
    np.maximum.at(top, shard.which, shard.doc)
    by_text = np.argsort(shard.which, kind="stable")
    edge = np.searchsorted(shard.which[by_text], np.arange(len(shard.texts) + 1))
    size = np.array([len(shard.texts[i]) for i in chosen.tolist()], np.int64)

    def of(some: np.ndarray) -> np.ndarray:
        """Occurrences of texts, in order."""
        n = edge[some + 1] - edge[some]
        return np.sort(by_text[np.arange(n.sum()) + np.repeat(edge[some] - (np.cumsum(n) - n), n)])

    for part in by_gram(shard.gram[chosen], size, index):
        texts = [shard.texts[i] for i in chosen[part].tolist()]
        some, other = _shared(texts, own[chosen[part]], top[chosen[part]], window)
        # a text that shares no window with another one goes, whole, wherever its first doc is smaller
        lone = chosen[part][some & ~other]
        occ = of(lone)
        occ = occ[own[shard.which[occ]] < shard.doc[occ]]
        out.append((occ, shard.place[occ], shard.place[occ] + shard.count[shard.which[occ]] + window - 1))
        mine, texts = chosen[part][other], [t for t, s in zip(texts, other.tolist()) if s]
        if texts:
            out += _marks(shard, mine, texts, own[mine], of(mine), window)
    return tuple(np.concatenate(x) for x in zip(*out))


def _marks(shard: Shard, mine: np.ndarray, texts: list[bytes], own: np.ndarray, occ: np.ndarray, window: int) -> list[tuple]:
    """Marks of the occurrences `occ` of the segments `mine`, from one index over their texts."""
    first, _, doc = RunIndex(texts, own, window).matching_statistics(texts)
    count = shard.count[mine]
    slot = np.full(len(shard.texts), -1)
    slot[mine] = np.arange(len(mine))
    earliest = np.minimum.reduceat(doc, first)
    occ = occ[earliest[slot[shard.which[occ]]] < shard.doc[occ]]
    out = []
    for at in range(0, len(occ), 1 << 16):
        some = occ[at : at + (1 << 16)]
        seg = slot[shard.which[some]]
        reps = count[seg]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        hit = doc[np.repeat(first[seg], reps) + inner] < np.repeat(shard.doc[some], reps)
        edge = inner == 0
        begin = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
        close = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
        owner = np.repeat(some, reps)[begin]
        out.append((owner, shard.place[owner] + inner[begin], shard.place[owner] + inner[close] + window))
    return out


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD, block: int = BLOCK, load: int = LOAD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if gram & (gram - 1) or gram > window:
        raise ValueError("a gram is a power of two bytes, no longer than a window")
    shards = shards_for(docs, shard_bytes)
    blobs, folder = spread(docs, Units(False, window, gram, block, load), shards)
    marks = by_shard(blobs, lambda s: locate(s, window))

    def work(text: bytes, found: np.ndarray) -> tuple:
        if not len(found):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        gone = mask(len(text), found)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), len(text) - len(kept), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()

    return finish(docs, marks, folder, work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, b, n, unnest(range(1, n + 1)) AS k FROM d),
s AS (SELECT doc_id, k, CASE WHEN k + 49 <= n THEN md5(b[k:k + 49]) END AS x, b[k:k] AS c FROM p),
f AS (SELECT *, CASE WHEN x IS NOT NULL AND min(doc_id) OVER (PARTITION BY x) < doc_id THEN 1 ELSE 0 END AS starts FROM s),
m AS (SELECT doc_id, k, c, max(starts) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), 0) = 0 THEN 1 ELSE 0 END AS opens FROM m),
a AS (SELECT doc_id, sum(gone) AS g, sum(opens) AS o, string_agg(hex(c), '' ORDER BY k) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(g, 0)::BIGINT AS n_removed, coalesce(o, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
