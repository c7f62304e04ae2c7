"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers, each with its states and weighted arcs:

* the normaliser N (`Normaliser`): a start state that writes the dummy prefix, and a loop that writes the
  white-space mark for a space and copies everything else;
* the pieces P (`Pieces`): a trie that reads characters and writes nothing, with an arc from the end of
  each piece back to the root that writes its id, and arcs of byte fallback that read a character without
  a piece and write the ids of its UTF-8 bytes;
* the order W (`Order`): an acceptor of piece sequences whose state is the last piece. A unigram model needs
  one state, as its weights (negative scores) are on P. A merge (BPE) model allows two neighbours where
  merging their text alone gives just these two pieces and weighs all others infinity. A boundary that no
  merge crosses leaves both sides' merges as they are, so exactly one path is finite: the merge result.

Input ∘ N ∘ P ∘ W is expanded lazily as a lattice over the places of the input; `Transducer.lattice` gives
its arcs and a relaxation in order of place takes the shortest path in the tropical semiring (min, +). As
each prefix has one finite path at most in a merge model, and W one state in a unigram model, the lattice
keeps one state a place. Decoding reads the same transducers the other way.

The lattice is cut where no piece crosses, at white space; a worker keeps a bounded cache of parts.

Defined cases: null text has null ids, empty text has none; characters outside the vocabulary become
byte pieces; the white-space mark itself decodes to a space, as the format has it; invalid UTF-8 is
replaced; very long texts take time in proportion to their length; an empty table gives an empty result;
extra columns are ignored. Models with a character map or other white-space rules are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.llm.common import kept, lean, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE, CACHED_LENGTH = 300_000, 48  # parts and neighbours that a worker keeps, twice over
INF = float("inf")


class _Memo(dict):
    """A cache of bounded size that fills itself; what was asked for since the last turn outlives it."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Normaliser:
    """N: arcs[state][character or None for none] = (what is written, next state); any other character is copied."""

    def __init__(self, prefix: bool):
        self.arcs = {0: {None: (MARK if prefix else "", 1)}, 1: {" ": (MARK, 1)}}
        self.start = self.arcs[0][None][0]

    def __call__(self, text: str) -> str:
        for c, (out, _) in self.arcs[1].items():
            text = text.replace(c, out)
        return self.start + text

    def back(self, text: bytes) -> bytes:
        return text[1:] if self.start and text[:1] == b" " else text


class Pieces:
    """P: a trie whose state is (character -> next state, label, weight), the last two those of the arc back to the root, or None."""

    def __init__(self, pieces: dict[str, int], weight: dict[str, float], far: float):
        self.root: list = [{}, None, 0.0]
        self.far = far
        for p, i in pieces.items():
            state = self.root
            for c in p:
                state = state[0].setdefault(c, [{}, None, 0.0])
            state[1:] = i, weight[p]

    def arcs(self, text: str, at: int):
        """(end, label, weight) of what P can write for text from `at`; byte fallback has the label -1 - code point."""
        state = self.root[0].get(text[at])
        if state is None or state[1] is None:
            yield at + 1, -1 - ord(text[at]), self.far
        end = at + 1
        while state is not None:
            if state[1] is not None:
                yield end, *state[1:]
            if end == len(text):
                return
            state = state[0].get(text[end])
            end += 1


class Order(dict):
    """W: the weight of label b in state a, as order[key(a, b)]; state and label are ids, -1 - code point or START."""

    SHIFT, START = 1 << 21, 1 << 20

    def __init__(self, names: dict[int, str], score: dict[str, float], most: int):
        self.names, self.score, self.most, self.old = names, score, most, {}

    def key(self, a: int, b: int) -> int:
        return (a + self.SHIFT) << 22 | (b + self.SHIFT)

    def name(self, label: int) -> str:
        return "" if label == self.START else self.names[label] if label >= 0 else chr(-1 - label)

    def __missing__(self, key: int) -> float:
        weight = self.old.get(key)
        if weight is None:
            a, b = self.name((key >> 22) - self.SHIFT), self.name((key & (1 << 22) - 1) - self.SHIFT)
            weight = 0.0 if neighbours(a, b, self.score) else INF
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = weight
        return weight


def neighbours(a: str, b: str, score: dict[str, float]) -> bool:
    """Whether the merge process on the text of a and b ends with just these two (with b alone where a is empty)."""
    s, none = list(a + b), -INF
    left = len(a)  # symbols of a's text so far; a merge of the last of them with the next crosses the boundary
    known = score.get
    pair = [known(x + y, none) for x, y in zip(s, s[1:])]
    while pair and (best := max(pair)) > none:
        i = pair.index(best)
        if i == left - 1:
            return False
        if i < left:
            left -= 1
        s[i : i + 2] = [s[i] + s[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = known(s[i - 1] + s[i], none)
        if i < len(pair):
            pair[i] = known(s[i] + s[i + 1], none)
    return len(s) == 1 + (a != "")


class Transducer:
    """A compiled model: encode(text) -> packed ids, decode(ids) -> text."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with marked white space is compiled")
        if m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not compiled")
        merges = m.trainer_spec.model_type == 2
        kind = pb.ModelProto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        score = {p.piece: p.score for p in m.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
        byte = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.bytes = [byte.get(f"<0x{b:02X}>", unknown) for b in range(256)]
        self.dtype = np.dtype("<u2" if len(m.pieces) <= 1 << 16 else "<u4")
        self.normaliser = Normaliser(norm.add_dummy_prefix)
        far = 10 - min(score.values(), default=0.0)
        self.pieces = Pieces(self.ids, dict.fromkeys(score, 0.0) if merges else {p: -x for p, x in score.items()}, 0.0 if merges else far)
        self.order = Order({i: p for p, i in self.ids.items()}, score, CACHE) if merges else None
        # the bytes each label writes, the text each id stands for, and where white space may be cut
        self.packed = {i: np.array([i], self.dtype).tobytes() for i in self.ids.values()}
        back: list[bytes] = [b""] * len(m.pieces)
        for p, i in self.ids.items():
            back[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            if i != unknown:
                back[i] = bytes([b])
        back[unknown] = " ⁇ ".encode()
        self.back = back
        self.parts = re.compile(self._cuts())
        self.cache = _Memo(self._path, CACHE)

    def _cuts(self) -> str:
        """A pattern of parts between which no piece lies, as far as the vocabulary allows it."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return r"(?s:.+)"
        if any("\n" in p and len(p) > 1 for p in self.ids):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        # after a run of letters and digits another kind of character starts a part, but for a few that pieces pair up
        pairs = {m[0] for p in self.ids for m in re.findall(r"(?=([^\W_][\W_]))", p)}
        other = rf"(?:[^\w{MARK}\n]|_)"
        more = f"(?:(?<=[{re.escape(''.join(sorted(pairs)))}]){other}+[^\\W_]*)*" if pairs else ""
        return rf"{MARK}*{other}*[^\W_]+" + more + rf"|{MARK}*{other}+|{MARK}+|\n"

    def _packed(self, label: int) -> bytes:
        return self.packed[label] if label >= 0 else np.array([self.bytes[b] for b in chr(-1 - label).encode()], self.dtype).tobytes()

    def lattice(self, part: str) -> Iterator[tuple[int, int, int, float]]:
        """Arcs (start, end, label, weight) of part ∘ P, in order of start."""
        for at in range(len(part)):
            for end, label, weight in self.pieces.arcs(part, at):
                yield at, end, label, weight

    def _path(self, part: str) -> bytes:
        """What the shortest path through part ∘ P ∘ W writes."""
        n, order, shift = len(part), self.order, Order.SHIFT
        cost, label, come = [0.0] + [INF] * n, [Order.START] + [0] * n, [0] * (n + 1)
        root, far = self.pieces.root[0], self.pieces.far
        for at in range(n):
            here = cost[at]
            if here == INF:
                continue
            row = (label[at] + shift << 22) + shift
            # the arcs of P from here, as Pieces.arcs has them
            state = root.get(part[at])
            if state is None or state[1] is None:
                c = -1 - ord(part[at])
                x = here + far + (order[row + c] if order is not None else 0.0)
                if x < cost[at + 1]:
                    cost[at + 1], label[at + 1], come[at + 1] = x, c, at
            end = at + 1
            while state is not None:
                states, out, weight = state
                if out is not None:
                    # weights of W aren't negative: an arc that is no better without one needs no look-up
                    x = here + weight
                    if x < cost[end] and (order is None or (x := x + order[row + out]) < cost[end]):
                        cost[end], label[end], come[end] = x, out, at
                if end == n:
                    break
                state = states.get(part[end])
                end += 1
        out = []
        while n:
            out.append(label[n])
            n = come[n]
        return b"".join([self._packed(x) for x in reversed(out)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = self.normaliser(text)
        parts = self.parts.findall(marked)
        if max(map(len, parts)) <= CACHED_LENGTH:
            return b"".join(map(self.cache.__getitem__, parts))
        return b"".join([self.cache[p] if len(p) <= CACHED_LENGTH else self._path(p) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        back = self.back
        return self.normaliser.back(b"".join(map(back.__getitem__, ids.tolist()))).decode("utf-8", "replace")


def compiled(model: bytes) -> Transducer:
    return kept(("pieces", hash(model)), lambda: Transducer(model))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids of docs (doc_id, text); with `digest` the SHA-256 of the ids instead and a round trip.

    ids_sha256 is over the ids as little-endian 32-bit integers; round_trip says that decoding the ids gives the text.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))  # the model file, fixed in size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            for b in slices(batch, 256):
                texts = [None if x is None else x.decode("utf-8", "replace") for x in b.column(1).to_pylist()]
                ids = [None if x is None else np.frombuffer(t.encode(x), t.dtype) for x in texts]
                count = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                if digest:
                    sha = [None if x is None else hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                    same = [None if x is None else t.decode(i) == x for x, i in zip(texts, ids)]
                    rest = [pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([b.column(0), count, *rest], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                else:
                    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
                    mask = pa.array([x is None for x in ids], pa.bool_())
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)
                    yield pa.RecordBatch.from_arrays([b.column(0), count, lists], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, {rest}")


def decode(rows: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    model = rows.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            for b in slices(batch, 256):
                texts = [None if x is None else t.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
