"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic; raking scales the cells of that table until its
source, language and topic marginals meet the targets; a document is then sampled with its cell's
calibrated rate, by a hash of its id, so a rerun task draws alike. The rate is the cell's weight (target
over actual share) times a scale. In production `keep` is `Copies(KEEP)`: that share of all tokens is
expected, and a document of a cell whose rate passes 1 is taken in as many whole copies, once more by a
draw for the fraction, so the expected marginals are the targets at any share. As a plain number, `keep`
excludes copies: cells that would pass 1 are taken whole, once, and their marginals fall short by what
they lack. Without `keep` the scale is the largest that passes 1 nowhere, and the marginals are met exactly.

Values outside the targets form one class, `OTHER`, per marginal and keep their actual share, so the
table has at most (sources + 1) (languages + 1) (topics + 1) cells, set by the targets and not by the
data; only that table reaches the driver or is broadcast. Counting is pre-aggregated before its
shuffle: a hot source is a row per task and cell.

Defined cases: null marginals and texts: OTHER and 0 tokens; targets of values that don't occur are
dropped and the rest rescaled; cells without tokens and documents without tokens have the
probability of the cell, 1 where nothing is known; repeated ids share one draw; an empty table gives an
empty result; extra columns are ignored. Copies of a document are as many rows of sample().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maillake.llm.common import cut, table

OTHER = "__other__"
MARGINALS = ("source", "lang", "topic")
SEED = 20240501
#: Share of all tokens that is sampled.
KEEP = 0.7


class Copies(float):
    """A share of all tokens that is met with whole copies where a rate passes 1."""


#: Production targets: the largest source is brought down, small languages up a little.
TARGETS = {
    "source": {"src0": 0.27, **{f"src{i}": 0.73 / 19 for i in range(1, 20)}},
    "lang": {"en": 0.52, "de": 0.18, "fr": 0.18, "es": 0.12},
    "topic": {"prose": 0.80, "table": 0.08, "noise": 0.06, "licence": 0.06},
}


def topic(text: Column) -> Column:
    """The form of a text, which the documents table has no column for."""
    return (
        F.when(text.rlike(r"(?i)\blicen[cs]e\b"), "licence")
        .when(text.contains(" | "), "table")
        .when(text.rlike(r"[%*&#$]{3}"), "noise")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rake(cells: np.ndarray, targets: list[np.ndarray], rounds: int = 200, near: float = 1e-10) -> np.ndarray:
    """Scale a table until its marginals have the target shares; zero cells stay zero."""
    fit = cells / cells.sum()
    for _ in range(rounds):
        gap = 0.0
        for axis, want in enumerate(targets):
            other = tuple(i for i in range(fit.ndim) if i != axis)
            have = fit.sum(other)
            scale = np.divide(want, have, out=np.ones_like(have), where=have > 0)
            gap = max(gap, float(np.abs(have - want).max()))
            fit = fit * scale.reshape([-1 if i == axis else 1 for i in range(fit.ndim)])
        if gap < near:
            break
    return fit


def shares(actual: np.ndarray, target: dict[str, float], names: list[str]) -> np.ndarray:
    """Target shares of the values that occur; the last name is OTHER, which keeps its actual share."""
    have = actual / actual.sum()
    want = np.array([target[n] for n in names[:-1]] + [0.0]) * (have > 0)
    return want / max(want.sum(), 1e-300) * (1 - have[-1]) + have * (np.arange(len(names)) == len(names) - 1) if want.sum() else have


def _cells(docs: DataFrame, targets: dict, topic_of: Column) -> DataFrame:
    known = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of}
    classes = [F.when(known[m].isin(list(targets[m])), known[m]).otherwise(OTHER).alias(m) for m in MARGINALS]
    return docs.select("doc_id", *classes, tokens(F.col("text")).alias("n_tokens"))


def scale_for(n: np.ndarray, weight: np.ndarray, keep: float | None) -> float:
    """The scale of weights by which the expected share of tokens is `keep`, repeats excluded unless it is Copies."""
    if isinstance(keep, Copies):
        return float(keep)  # weights are 1 on average over tokens
    if keep is None:
        return 1 / weight[n > 0].max()
    if not 0 < keep <= 1:
        raise ValueError("keep is a share")
    low, high = 0.0, 1 / weight[n > 0].min()
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if (n * np.minimum(1, middle * weight)).sum() > keep * n.sum() else (middle, high)
    return high


def calibrate(counts: DataFrame, targets: dict, keep: float | None) -> list[tuple[str, str, str, float, float]]:
    """(source, lang, topic, weight, rate) of each cell: target over actual share, expected copies of a document."""
    rows = counts.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n")).collect()  # bounded by the targets
    names = [[*targets[m], OTHER] for m in MARGINALS]
    at = [{n: i for i, n in enumerate(x)} for x in names]
    cells = np.zeros([len(x) for x in names])
    for r in rows:
        cells[tuple(a[r[m]] for a, m in zip(at, MARGINALS))] = r["n"] or 0
    if cells.sum() == 0:
        return [(*(r[m] for m in MARGINALS), 1.0, 1.0) for r in rows]
    want = [shares(cells.sum(tuple(j for j in range(3) if j != i)), targets[m], names[i]) for i, m in enumerate(MARGINALS)]
    weight = np.divide(rake(cells, want), cells / cells.sum(), out=np.ones_like(cells), where=cells > 0)
    scale = scale_for(cells, weight, keep)
    out = []
    for r in rows:
        w = float(weight[tuple(a[r[m]] for a, m in zip(at, MARGINALS))])
        rate = float(w * scale)
        out.append((*(r[m] for m in MARGINALS), w, rate if isinstance(keep, Copies) else min(1.0, rate)))
    return out


def drawn(rate: Column, seed: int) -> Column:
    """How many copies of a document are taken: the whole part of the rate, and one more by its fraction."""
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, targets: dict = TARGETS, topic_of: Column | None = None, seed: int = SEED, keep: float | None = Copies(KEEP)) -> DataFrame:
    """One row per row of docs (doc_id, text, source, lang): doc_id, source, lang, topic, n_tokens, weight, probability (of any copy), copies, kept."""
    rows = cut(_cells(docs, targets, topic(F.col("text")) if topic_of is None else topic_of))  # narrow; texts are read once
    spark = docs.sparkSession
    found = calibrate(rows, targets, keep)
    cells = spark.createDataFrame(found, "source string, lang string, topic string, weight double, rate double")
    out = rows.join(F.broadcast(cells), list(MARGINALS), "left").withColumn("copies", drawn(F.col("rate"), seed))
    return out.select("doc_id", *MARGINALS, "n_tokens", "weight", F.least("rate", F.lit(1.0)).alias("probability"), "copies", (F.col("copies") > 0).alias("kept"))


def sample(docs: DataFrame, targets: dict = TARGETS, seed: int = SEED, keep: float | None = Copies(KEEP)) -> DataFrame:
    """The rows of docs that are drawn, a row a copy, all columns kept; the cell is looked up beside the text, without a shuffle."""
    kinds = _cells(docs, targets, topic(F.col("text")))
    found = calibrate(kinds, targets, keep)
    names = {"__maillake_s": F.col("source"), "__maillake_l": F.col("lang"), "__maillake_t": topic(F.col("text"))}
    cells = docs.sparkSession.createDataFrame([(s, l, t, p) for s, l, t, _, p in found], "__maillake_s string, __maillake_l string, __maillake_t string, __maillake_p double")
    rows = docs.withColumns({k: F.when(c.isin(list(targets[m])), c).otherwise(OTHER) for (k, c), m in zip(names.items(), MARGINALS)})
    taken = rows.join(F.broadcast(cells), list(names), "left").withColumn("__maillake_c", drawn(F.col("__maillake_p"), seed))
    once = F.array_repeat(F.lit(0), F.col("__maillake_c"))
    return taken.where("__maillake_c > 0").select(*docs.columns, F.explode(once).alias("__maillake_n")).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
