"""From raw documents to token ids: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the rows they keep with the columns of
docs. Stages hold no state of each other: each sees what its predecessor kept, written and read again.

Defined cases: rows with null text or without a letter leave at language ID; of rows that repeat doc_id and
text one passes exact dedup, and rows of one doc_id, or none, with different texts are judged each by its
own; mixing may keep several copies of a document; an empty table stays empty; extra columns are carried
to the last stage, which returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maillake.llm import common, exact, langid, mixing, pieces, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of at least 0.5."""
    common.ship(spark)
    return langid.accept(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document, then of the smallest doc_id, of equal ones."""
    return exact.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash component, by op1's contract (3-word shingles, 3 bits); for its recall see README."""
    common.ship(spark)
    return simhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that meet the target marginals."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    common.ship(spark)
    return pieces.encode(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix),
    ("SentencePiece", encode),
]

#: Fitted models and SimHash are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)
    return docs
