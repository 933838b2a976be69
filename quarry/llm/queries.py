"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontam, flac, jaccard, language, markup, periods, records, simhash, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return {
        "pipeline": pipeline,
        "op1_simhash": simhash.op1_simhash,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_token_records": records.op4_token_records,
        "op5_language_id": language.op5_language_id,
        "op6_html_text": markup.op6_html_text,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_tool_calls": chat.op8_tool_calls,
        "op9_flac": flac.op9_flac,
        "op10_bpe_round_trip": tokens.op10_bpe_round_trip,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_ngram_jaccard": jaccard.op13_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {}
