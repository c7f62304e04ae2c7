import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from maillake.llm import pieces

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Transducer(open(pieces.MODEL, "rb").read())


def texts():
    rng = random.Random(2)
    out = ["", " ", "a", "  two  spaces ", "\n\n x\ty", "naïve café 你好 😀́", "aaaaaaaaaaaaa", "a" * 3000, " " * 70, "\x00\x01", "<s></s><unk> <0x41>", "▁ mark", "mixed\n   deep\n\tindent"]
    alphabet = "abcdeinorst  \n.,ThäéñΩ漢😀0123456789-_=<>/"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    words = ["the", "there", "in", "ing", "er", "hello", "ation", "re", "ou", "wh", "st", "les", "token"]
    out += ["".join(rng.choice(words) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    return out


def test_encoding_equals_the_library(own, library):
    for t in texts():
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == library.encode(t), repr(t)


def test_decoding_equals_the_library(own, library):
    rng = random.Random(4)
    for t in texts():
        ids = library.encode(t)
        assert own.decode(np.array(ids, int)) == library.decode(ids)
        assert own.decode(np.array(ids, int)) == t.replace("▁", " ")
    for _ in range(300):  # bytes that are no text
        ids = [rng.randrange(3, 32000) for _ in range(8)]
        assert own.decode(np.array(ids)).replace("�", "") == library.decode(ids).replace("�", "")


def test_documents_equal_the_library(own, library, duck):
    for (t,) in duck("sf0.001").sql("SELECT text FROM documents").fetchall():
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == library.encode(t)


def test_unigram_models_take_the_cheapest_path():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.remove_extra_whitespaces = False
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -4.0, "ba": -4.0, "bab": -9.0}
    m.pieces.add(piece="<unk>", type=2)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s)
    t = pieces.Transducer(m.SerializeToString())

    def best(x):
        if not x:
            return 0.0
        return max((scores[x[:k]] + best(x[k:]) for k in range(1, 4) if x[:k] in scores), default=-1e9)

    for text in ("ab", "abab", "babab", "aabb", "ba ab"):
        ids = np.frombuffer(t.encode(text), t.dtype).tolist()
        cost = sum(list(scores.values())[i - 1] for i in ids)
        assert cost == pytest.approx(best("▁" + text.replace(" ", "▁"))) and t.decode(np.array(ids)) == text


def test_operator_and_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "word " * 40_000), (5, "z" * 20_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    out = pieces.encode(df)
    got = sorted((r.doc_id, r.n_tokens, r.ids) for r in out.collect())
    assert got == sorted((i, None, None) if t is None else (i, len(library.encode(t)), library.encode(t)) for i, t in rows)
    back = sorted(map(tuple, pieces.decode(out).collect()), key=lambda r: (r[0], r[1] or ""))
    assert back == sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert pieces.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, library):
    import hashlib

    want = {
        r[0]: (len(ids := library.encode(r[1])), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), True)
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    }
    assert {r[0]: tuple(r)[1:] for r in pieces.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_the_arcs_of_the_normaliser(own):
    n = own.normaliser
    assert n.arcs == {0: {None: ("▁", 1)}, 1: {" ": ("▁", 1)}}
    assert n("a b\t c") == "▁a▁b\t▁c" and n.back(b" a b") == b"a b"
    assert pieces.Normaliser(False)("a b") == "a▁b"


def test_the_arcs_of_the_pieces(own, library):
    for text in ("▁hello", "the", "漢xé", "\u1234a", "aaaa"):
        got = {(a, b, x) for a, b, x, _ in own.lattice(text)}
        want = {(a, b, own.ids[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in own.ids}
        want |= {(a, a + 1, -1 - ord(c)) for a, c in enumerate(text) if c not in own.ids}
        assert got == want
    state = own.pieces.root
    for c in "▁the":
        state = state[0][c]
    assert state[1:] == [library.piece_to_id("▁the"), 0.0]


def test_the_weights_of_the_order(own, library):
    order, ids = own.order, own.ids
    weight = lambda a, b: order[order.key(ids[a] if a else order.START, ids[b])]
    assert weight("▁the", "re") == (0.0 if library.encode("there", out_type=str) == ["▁the", "re"] else float("inf"))
    assert weight("t", "h") == float("inf") and weight("", "▁the") == 0.0
    # every pair that the library puts side by side is allowed
    for text in ("hello there, wanderer", "tokenisation of naïve text", "in the beginning"):
        row = library.encode(text, out_type=str)
        assert all(weight(a, b) == 0.0 for a, b in zip(row, row[1:]))
    assert order.name(-1 - ord("é")) == "é"


def test_exactly_one_path_is_finite(own, library):
    """All paths through the lattice of short texts: one has a finite weight, the library's."""
    for text in ("there", "inning", "aaaaa", "reentered", "▁wander", "xé漢"):
        arcs = {}
        for a, b, label, w in own.lattice(text):
            arcs.setdefault(a, []).append((b, label, w))
        finite = []

        def walk(at, last, cost, path):
            if at == len(text):
                finite.append(path)
                return
            for b, label, w in arcs[at]:
                x = cost + w + own.order[own.order.key(last, label)]
                if x < float("inf"):
                    walk(b, label, x, [*path, label])

        walk(0, own.order.START, 0.0, [])
        assert len(finite) == 1
        assert own._path(text) == b"".join(map(own._packed, finite[0]))
