"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, which a forward algorithm gives; a
text's is the product over its words. Piece probabilities are trained by expectation-maximisation
(forward-backward) on labelled rows; the vocabulary itself is never trained.

Only fitting reads a sample: at most `DOCS_PER_LANGUAGE` rows of each language, those of least hash, each
text whole; words of more than `TRAIN_LETTERS` letters teach nothing. Prediction reads every text whole,
words of any length included. Its inner loop is vectorised over the distinct words of a block and keeps
only as many positions as the longest piece has letters, on a running scale; each worker keeps a bounded
cache of word scores.

Words are runs of letters, lower-cased; any other character, number signs included, ends a word.
Defined cases: a null text or one without a letter gets `und` and score 0, as does every text when no
row is labelled; rows with null doc_id may be trained on; repeated rows are predicted alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maillake.llm.common import ROW, kept, lean, row_key, slices, table, trim

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DOCS_PER_LANGUAGE, TRAIN_LETTERS, ROUNDS = 400, 1000, 4
CACHE, BLOCK = 200_000, 1 << 17  # words whose scores a worker keeps; letters of a block
LONG = 256  # letters of a word from which it is summed by itself, letter after letter
_WORDS = re.compile(r"[^\W\d_]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """All lower-cased pieces of letters (with the word-start mark)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p == "▁" or p.removeprefix("▁").isalpha())


class Lookup:
    """Vectorised map from hashed pieces to their index; absent keys get the index `n`."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        n = len(keys)
        self.tables = []
        left = np.arange(n)
        for mix in _MIX:
            t = np.full(1 << 20, n, np.int32)
            slot = (keys[left] * mix) >> np.uint64(44)
            t[slot] = left
            left = left[t[slot] != left]
            self.tables.append(t)
        self.rest = {int(keys[i]): int(i) for i in left}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.keys) - 1
        out = self.tables[0][(keys * _MIX[0]) >> np.uint64(44)]
        miss = np.flatnonzero(self.keys[out] != keys)
        second = self.tables[1][(keys[miss] * _MIX[1]) >> np.uint64(44)]
        second[self.keys[second] != keys[miss]] = n
        out[miss] = second
        if self.rest:
            for i in np.flatnonzero(out == n).tolist():
                out[i] = self.rest.get(int(keys[i]), n)
        return out


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return h


class Lattice:
    """The arcs of all segmentations of words: for each end and length, the piece index of each word."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)  # index n: a single character that is no piece; n + 1: no arc
        self.longest = max(map(len, pieces), default=1)
        self.find = Lookup(np.array([_hash(p) for p in pieces], np.uint64))
        self.power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        codes = _codes(words).astype(np.uint64)
        n, width = codes.shape
        h = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            h[i + 1] = h[i] * _BASE + codes[:, i] + np.uint64(1)
        for i in range(1, width + 1):
            inside = codes[:, i - 1] != 0
            for k in range(1, min(self.longest, i) + 1):
                piece = self.find(h[i] - h[i - k] * self.power[k])
                yield i, k, np.where(inside & ((piece < self.n) | (k == 1)), piece, self.n + 1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Blocks of marked words of like length, of bounded size together, with their places."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + max(1, BLOCK // int(size[order[at]] + 1))]
        yield part, ["▁" + words[i] for i in part.tolist()]
        at += len(part)


class Model:
    """languages, and log-likelihoods of words under each."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self.lattice = Lattice(pieces)

    def _long(self, word: str) -> np.ndarray:
        """The same sum for one word of any length; its pieces are looked up all at once."""
        codes, h, mask = np.frombuffer(word.encode("utf-32-le"), np.uint32).tolist(), [0], (1 << 64) - 1
        for c in codes:
            h.append((h[-1] * int(_BASE) + c + 1) & mask)
        h = np.array(h, np.uint64)
        ends, sizes, pieces = [], [], []
        for k in range(1, min(self.lattice.longest, len(codes)) + 1):
            piece = self.lattice.find(h[k:] - h[:-k] * self.lattice.power[k])
            good = np.flatnonzero((piece < self.lattice.n) | (k == 1))
            ends.append(good + k)
            sizes.append(np.full(len(good), k))
            pieces.append(piece[good])
        ends, sizes, pieces = map(np.concatenate, (ends, sizes, pieces))
        order = np.argsort(ends, kind="stable")
        first = np.searchsorted(ends[order], np.arange(1, len(codes) + 2)).tolist()
        back, out = sizes[order].tolist(), np.zeros(len(self.languages))
        for j in range(len(self.languages)):
            p = self.p[pieces[order], j].tolist()
            sums = deque([1.0], self.lattice.longest + 1)
            for a, b in zip(first, first[1:]):
                x = 0.0
                for i in range(a, b):
                    x += sums[-back[i]] * p[i]
                sums.append(x)
                if x < 1e-100:
                    scale = max(sums)
                    out[j] += np.log(scale)
                    sums = deque([y / scale for y in sums], sums.maxlen)
            out[j] += np.log(max(sums[-1], 1e-300))
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        short = [w for w in words if len(w) < LONG]
        if len(short) < len(words):
            long = np.array([len(w) >= LONG for w in words])
            out[long] = [self._long("▁" + w) for w in words if len(w) >= LONG]
            out[~long] = self.scores(short)
            return out
        for part, block in _by_length(words):
            ends = np.array([len(w) for w in block])
            # the last positions of the forward sums, on a scale of their own for each word and language
            ring = np.zeros((self.lattice.longest + 1, len(block), len(self.languages)))
            ring[0] = 1
            scale = np.zeros(ring.shape[1:])
            turn, now = len(ring), 0
            for i, k, piece in self.lattice.arcs(block):
                if i != now:
                    now = i
                    alpha = ring[i % turn]
                    alpha[:] = 0
                hit = np.flatnonzero(piece <= self.lattice.n)
                alpha[hit] += ring[(i - k) % turn][hit] * self.p[piece[hit]]
                if k == min(turn - 1, i):  # the last arc into this position
                    over = np.flatnonzero(ends == i)
                    if len(over):
                        out[part[over]] = np.log(np.maximum(alpha[over], 1e-300)) + scale[over]
                    if i % 8 == 0:
                        most = ring.max(0)
                        most[most == 0] = 1
                        ring /= most
                        scale += np.log(most)
        return out


def train(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities to word counts by language."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    times = np.array([[counts[k][w] for k in languages] for w in words], float).reshape(len(words), len(languages))
    n = len(pieces)
    lengths = np.array([len(x) for x in pieces] + [1.0])
    p = np.repeat((0.02 ** lengths / (0.02 ** lengths).sum())[:, None], len(languages), axis=1)
    lattice = Lattice(pieces)
    level = 16.0 ** lengths[:, None]  # a factor a letter is common to all segmentations and keeps long words in range
    for _ in range(rounds if words else 0):
        gained = np.zeros((n + 2, len(languages)))
        ext = np.vstack([p * level, np.zeros((1, len(languages)))])
        for part, block in _by_length(words):
            arcs = list(lattice.arcs(block))
            width, rows = max(map(len, block)), np.arange(len(block))
            ends = np.array([len(w) for w in block])
            alpha, beta = np.zeros((2, width + 1, len(block), len(languages)))
            alpha[0] = 1
            for i, k, piece in arcs:
                alpha[i] += alpha[i - k] * ext[piece]
            beta[ends, rows] = 1
            for i, k, piece in reversed(arcs):
                beta[i - k] += beta[i] * ext[piece]
            share = times[part] / np.maximum(alpha[ends, rows], 1e-300)
            for i, k, piece in arcs:
                use = alpha[i - k] * ext[piece] * beta[i] * share
                for j in range(len(languages)):
                    gained[:, j] += np.bincount(piece, use[:, j], n + 2)
        gained = gained[: n + 1]
        everywhere = gained.sum(1, keepdims=True) + 0.01
        everywhere /= everywhere.sum()
        p = 0.98 * gained / np.maximum(gained.sum(0), 1e-9) + 0.02 * everywhere
    return Model(languages, pieces, p)


def words_of(text: str) -> list[str]:
    found = _WORDS.findall(text.lower())
    if "".join(found).isalpha():
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text.decode("utf-8", "replace")) if len(w) <= TRAIN_LETTERS)
        langs, words = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out third."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", "text", row_key().alias(ROW))
    # a share of each language is drawn first, some four times what is needed, so that few rows are ranked
    sizes = labelled.groupBy("lang").count().collect()  # a row per language
    share = docs.sparkSession.createDataFrame([(r[0], 4.0 * DOCS_PER_LANGUAGE / r[1]) for r in sizes], "lang string, share double")
    w = Window.partitionBy("lang").orderBy(ROW)
    chosen = (
        labelled.where("text is not null")
        .join(F.broadcast(share), "lang")
        .where(F.pmod(ROW, F.lit(1 << 32)) / float(1 << 32) < F.col("share"))
        .select("lang", ROW)
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= DOCS_PER_LANGUAGE)
        .select("lang", ROW)
        .distinct()
    )
    # at most DOCS_PER_LANGUAGE rows a language are broadcast, and their word counts collected
    rows = labelled.join(F.broadcast(chosen), ["lang", ROW], "left_semi").select("lang", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(lean(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {r[0]: Counter() for r in chosen.select("lang").distinct().collect()}
    for r in found.toLocalIterator() if counts else ():
        counts[r["lang"]][r["word"]] = r["n"]
    model = train({k: c for k, c in counts.items() if c}, vocabulary(vocabulary_path))
    del counts
    trim()  # the driver goes on with other work
    return model


class Scorer:
    """Predicts texts with one model; word scores are cached up to CACHE distinct words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.zeros((4096, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.index) + len(words) > CACHE:
            self.reset()
        fresh = sorted(words.difference(self.index))
        need = len(self.index) + len(fresh)
        if need > len(self.values):
            self.values = np.vstack([self.values, np.zeros((max(need, len(self.values)), self.values.shape[1]))])
        if fresh:
            self.values[len(self.index) : need] = self.model.scores(fresh)
            self.index.update(zip(fresh, range(len(self.index), need)))

    def total(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of a text by language."""
        out = np.zeros(len(self.model.languages))
        for at in range(0, len(words), CACHE // 4):
            part = words[at : at + CACHE // 4]
            if not self.index.keys() >= (distinct := set(part)):
                self.learn(distinct)
            out += self.values[np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))].sum(0)
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        split = [words_of((t or b"").decode("utf-8", "replace")) for t in texts]
        together = set().union(*map(set, split)) if split else set()
        if len(together) <= CACHE:
            self.learn(together)
        out = []
        for words in split:
            if not words or not self.model.languages:
                out.append(("und", 0.0))
                continue
            total = self.total(words)
            e = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(e[best] / e.sum())))
        return out


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(shared.id, lambda: Scorer(Model(*shared.value)))
        for batch in batches:
            for b in slices(batch, 256):
                found = scorer.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


class _Shared:
    """A broadcast that knows which model it holds."""

    def __init__(self, spark: SparkSession, model: Model):
        self.b = spark.sparkContext.broadcast((model.languages, model.pieces, model.p))  # vocabulary times languages
        self.id = f"{spark.sparkContext.applicationId}-{id(self)}-{hash(model.p.tobytes())}"

    @property
    def value(self):
        return self.b.value


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text)."""
    shared = _Shared(docs.sparkSession, model)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_predictor(shared)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose language is found with at least this score."""
    shared = _Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(shared.id, lambda: Scorer(Model(*shared.value)))
        for batch in batches:
            for b in slices(batch, 256):
                texts = b.column("text").cast(pa.binary()).to_pylist()
                keep = [lang != "und" and score >= least for lang, score in scorer.predict(texts)]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
