"""Queries of this subpackage, one per operator, with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_index

    return token_file_index(table(spark, sf_dir, "documents"), _word_bpe(), end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"), length=50).drop("spans")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import fixity_drill

    return fixity_drill(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _word_bpe(), capacity=2048, end_id=0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotraining import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import backoff_scores

    scores = backoff_scores(table(spark, sf_dir, "documents"), order=3, backoff=0.4)
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_token_files, op4_decontamination, op5_suffix_array_dedup, op6_warc_fixity, op7_best_fit_packing, op8_quality_classifier, op9_lm_scoring, op10_simhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    from . import lm_scoring, quality_rules, warc

    return {"op2_quality_rules": quality_rules.ORACLE, "op6_warc_fixity": warc.ORACLE, "op9_lm_scoring": lm_scoring.ORACLE}
