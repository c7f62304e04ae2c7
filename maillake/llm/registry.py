"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from maillake.llm import chat, common, embed, exact, langid, mixing, phrases, pieces, rlindex, simhash, tokencount


def _shipped(f):
    def run(spark, sf_dir):
        common.ship(spark)
        return f(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {
        "op1_simhash_near_dedup": simhash.query,
        "op2_sentencepiece": pieces.query,
        "op3_suffix_array_dedup": rlindex.query,
        "op4_exact_dedup": exact.query,
        "op5_token_counts": tokencount.query,
        "op6_chat_formatting": chat.query,
        "op7_substring_dedup": phrases.query,
        "op8_mixing": mixing.query,
        "op9_language_id": langid.query,
        "op10_embedding_near_dedup": embed.query,
        "pipeline": _pipeline,
    }
    return {k: _shipped(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_array_dedup": rlindex.SQL,
        "op4_exact_dedup": exact.SQL,
        "op6_chat_formatting": chat.SQL,
        "op7_substring_dedup": phrases.SQL,
        "op10_embedding_near_dedup": embed.SQL,
    }
