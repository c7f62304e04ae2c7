"""Substring dedup of words by repeated-phrase automata.

Windows of 35 words are routed to shards by minimizer (see windows.py). In a shard, recurring passages
are confirmed: segments that occur more than once as a whole, and windows that occur in more than one
segment or place. These compile into the shard's Aho-Corasick automaton over word numbers, through which
every segment of every document that could hold them streams; what it locates is marked. The automaton
compares words, not hashes, and a pattern that it finds only once is dropped, so no collision marks a word.

Defined cases: null and blank texts have no words; texts below 35 words lose nothing; a window that recurs
in its own document counts; repeated rows recur; rows of different texts under one doc_id, or none, are
marked each for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from maillake.llm.common import table
from maillake.llm.windows import Shard, Units, by_gram, by_shard, finish, mask, mixed, shards_for, spread

WINDOW, GRAM, BLOCK, SHARD, INDEX = 35, 16, 4 << 20, 8 << 20, 3 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all runs of `window` values."""
    out = np.zeros(max(0, len(values) - window + 1), np.uint64)
    for k in range(window):
        out = out * _ODD + values[k : k + len(out)]
    return out


def locate(shard: Shard, window: int, index: int = INDEX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (index of the occurrence, start, stop in words) of the shard's recurring passages; an automaton holds about `index` bytes."""
    out = [(np.zeros(0, np.int64),) * 3]
    if not len(shard.which):
        return out[0]
    times = np.bincount(shard.which, minlength=len(shard.texts))
    live = np.bincount(shard.gram[shard.which], minlength=shard.gram.max() + 1)[shard.gram] > 1
    chosen = np.flatnonzero(live)
    by_text = np.argsort(shard.which, kind="stable")
    edge = np.searchsorted(shard.which[by_text], np.arange(len(shard.texts) + 1))
    size = np.array([len(shard.texts[i]) for i in chosen.tolist()], np.int64)
    for part in by_gram(shard.gram[chosen], size, index):
        mine = chosen[part]
        occ = np.sort(np.concatenate([by_text[edge[i] : edge[i + 1]] for i in mine.tolist()]))
        out.append(_marks(shard, mine, times, occ, window))
    return tuple(np.concatenate(x) for x in zip(*out))


def _marks(shard: Shard, chosen: np.ndarray, times: np.ndarray, occ: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the occurrences `occ` of the segments `chosen`, from one automaton."""
    nothing = (np.zeros(0, np.int64),) * 3
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in shard.texts[i].split(b" ")] for i in chosen.tolist()]
    flat = np.array([x for s in words for x in s], np.int64)
    size = np.array([len(s) for s in words])
    first = np.cumsum(size) - size
    # confirm: windows in more than one place, unless whole segments already tell
    places = np.concatenate([np.arange(f, f + n - window + 1) for f, n in zip(first.tolist(), size.tolist())])
    of = np.repeat(np.arange(len(words)), size - window + 1)
    hashes = _window_hashes(mixed(flat.astype(np.uint64) + np.uint64(1)), window)[places]
    _, index, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    once = np.bincount(inverse, times[chosen][of] == 1, len(count)) > 0
    patterns = [tuple(words[i]) for i in np.flatnonzero(times[chosen] > 1).tolist()]
    patterns += [tuple(flat[p : p + window].tolist()) for p in places[index[(count > 1) & once]].tolist()]
    if not patterns:
        return nothing
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(dict.fromkeys(patterns)):
        automaton.add_word(p, (i, len(p)))
    automaton.make_automaton()
    hits = [(i, s, end + 1 - n, end + 1) for s, w in enumerate(words) for end, (i, n) in automaton.iter(tuple(w))]
    pattern, seg, start, stop = np.array(hits, np.int64).reshape(-1, 4).T
    again = np.bincount(pattern, times[chosen][seg], pattern.max() + 1 if len(pattern) else 0)[pattern] > 1
    delta = np.zeros(len(flat) + 1, np.int64)
    np.add.at(delta, first[seg[again]] + start[again], 1)
    np.add.at(delta, first[seg[again]] + stop[again], -1)
    covered = np.cumsum(delta[:-1]) > 0
    # intervals of each segment, then of each place it occurs at
    edge = np.zeros(len(flat), bool)
    edge[first] = True
    begin = np.flatnonzero(covered & (edge | ~np.concatenate([[False], covered[:-1]])))
    close = np.flatnonzero(covered & (np.append(edge[1:], True) | ~np.append(covered[1:], False))) + 1
    owner = np.searchsorted(first, begin, "right") - 1
    per = np.bincount(owner, minlength=len(words))
    slot = np.full(len(shard.texts), -1)
    slot[chosen] = np.arange(len(chosen))
    local = slot[shard.which]
    occ = occ[per[local[occ]] > 0]
    reps = per[local[occ]]
    base = (np.cumsum(per) - per)[local[occ]]
    k = np.repeat(base, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    at = np.repeat(shard.place[occ], reps) - first[owner[k]]
    return np.repeat(occ, reps), begin[k] + at, close[k] + at


def phrase_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    if gram & (gram - 1) or gram > window:
        raise ValueError("a gram is a power of two words, no longer than a window")
    shards = shards_for(docs, shard_bytes)
    blobs, folder = spread(docs, Units(True, window, gram, block), shards)
    marks = by_shard(blobs, lambda s: locate(s, window))

    def work(text: bytes, found: np.ndarray) -> tuple:
        words = text.split()
        if len(found):
            gone = mask(len(words), found)
            words_kept = [w for w, g in zip(words, gone.tolist()) if not g]
        else:
            words_kept = words
        return len(words), len(words) - len(words_kept), hashlib.sha256(b" ".join(words_kept)).hexdigest()

    return finish(docs, marks, folder, work, "n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
s AS (SELECT doc_id, k, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS x FROM u
  WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY md5(x)) AS times FROM s WHERE n = 35) WHERE times > 1),
m AS (SELECT u.doc_id, word, u.k, max(CASE WHEN r.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.doc_id ORDER BY u.k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.k = u.k),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
