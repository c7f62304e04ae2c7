import itertools
import math
from collections import Counter

import numpy as np
import pytest

from maillake.llm import langid

DOCS = "doc_id long, text string, lang string"


def test_scores_sum_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "▁ab"]
    p = np.random.default_rng(0).random((len(pieces) + 1, 2))
    m = langid.Model(["x", "y"], pieces, p)
    words = ["ab", "abba", "b", "bab", "cab", "ababababab"]

    def total(text, k):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, min(3, len(text)) + 1):
            if text[:n] in pieces:
                out += p[pieces.index(text[:n]), k] * total(text[n:], k)
            elif n == 1:
                out += p[len(pieces), k] * total(text[1:], k)
        return out

    got = m.scores(words)
    for i, k in itertools.product(range(len(words)), range(2)):
        assert got[i, k] == pytest.approx(math.log(total("▁" + words[i], k)))


def test_long_pieces_and_long_words_are_summed_whole():
    pieces = ["▁", "a", "b", "abababababab", "bababababababab", "▁abababababababa", "ab"]
    p = np.random.default_rng(3).random((len(pieces) + 1, 2)) / 4
    m = langid.Model(["x", "y"], pieces, p)

    def total(text, k):
        sums = [1.0]
        for i in range(1, len(text) + 1):
            here = 0.0
            for n in range(1, min(16, i) + 1):
                piece = text[i - n : i]
                if piece in pieces:
                    here += sums[i - n] * p[pieces.index(piece), k]
                elif n == 1:
                    here += sums[i - 1] * p[len(pieces), k]
            sums.append(here)
        return sums[-1]

    words = ["ab" * 8, "ab" * 17, "ab" * 20 + "c", "ba" * 45, "ab" * 150, "a" * 254, "a" * 255, "abc" * 90]
    got = m.scores(words)
    for i, k in itertools.product(range(len(words)), range(2)):
        assert got[i, k] == pytest.approx(math.log(total("▁" + words[i], k)))
    # beyond the range of a float: a run of one letter grows in proportion
    one, two = m.scores(["c" * 40_000, "c" * 80_000])
    np.testing.assert_allclose(two - one, 40_000 * np.log(p[len(pieces)]))
    assert max(map(len, langid.vocabulary())) > 8


def test_words_are_runs_of_letters():
    assert langid.words_of("½cup ²abc x_y 12a Été") == ["cup", "abc", "x", "y", "a", "été"]
    assert langid.words_of("½ ² 12 _") == []


def slow_query(rows):
    """The prediction by definition, from the model that was fitted: rows (doc_id, text)."""
    import unicodedata

    def predict(model, text):
        words, word = [], ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] == "L":
                word += c
            elif word:
                words.append(word)
                word = ""
        if not words:
            return "und", 0.0
        index = {x: i for i, x in enumerate(model.pieces)}
        most = max(map(len, model.pieces))
        total = np.zeros(len(model.languages))
        for w in words:
            w = "▁" + w
            sums = [np.ones(len(model.languages))]
            for i in range(1, len(w) + 1):
                arcs = [(n, index[w[i - n : i]]) for n in range(1, min(most, i) + 1) if w[i - n : i] in index]
                if w[i - 1] not in index:
                    arcs.append((1, len(model.pieces)))
                sums.append(sum(sums[i - n] * model.p[q] for n, q in arcs))
            total += np.log(sums[-1])
        share = np.exp(total - total.max())
        return model.languages[int(total.argmax())], float(share.max() / share.sum())

    return predict, rows


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    predict, rows = slow_query([tuple(r) for r in docs.select("doc_id", "text").collect()])
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        lang, score = predict(model, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-6)


def test_training_raises_the_likelihood():
    counts = {"x": Counter({"abab": 5, "aab": 2}), "y": Counter({"bbb": 4, "ab": 1})}
    pieces = ["▁", "a", "b", "ab", "▁ab", "bb"]

    def likelihood(m):
        s = {w: m.scores([w])[0] for c in counts.values() for w in c}
        return sum(n * s[w][m.languages.index(k)] for k, c in counts.items() for w, n in c.items())

    fitted = [likelihood(langid.train(counts, pieces, r)) for r in (1, 2, 6)]
    assert fitted[0] < fitted[1] <= fitted[2] + 0.1


def test_held_out_accuracy(spark):
    import zlib

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    rows = langid.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right)
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    learn = [(i, "the cat sat on the mat and the dog" if i % 2 else "der hund und die katze auf dem haus", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 ²% _", "de"), (103, "und der hund", None), (103, "und der hund", None), (104, "the dog " * 30_000, None), (None, "the mat", None), (105, "x" * 5000, None), (106, "the Ωцат", None), (107, "½der ²hund ½und ²die", None), (108, "½ ²", None)]
    df = spark.createDataFrame(learn + odd, DOCS)
    from pyspark.sql import functions as F

    df = df.withColumn("score", F.lit("clash"))
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(df, langid.fit(df)).collect() if r.doc_id is None or r.doc_id >= 100)
    assert [x for x in got if x[0] != "105"] == [("100", "und"), ("101", "und"), ("102", "und"), ("103", "de"), ("103", "de"), ("104", "en"), ("106", "en"), ("107", "de"), ("108", "und"), ("None", "en")]
    kept = langid.accept(df, langid.fit(df))
    assert kept.columns == df.columns and {r.doc_id for r in kept.where("doc_id >= 100 or doc_id is null").collect()} >= {103, 104, None}
    assert kept.where("doc_id in (100, 101, 102)").count() == 0
    none = spark.createDataFrame([(1, "text", None)], DOCS)
    assert [tuple(r)[2:] for r in langid.predict(none, langid.fit(none)).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0).select("doc_id", "text"), langid.fit(df)).count() == 0
