"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, line_dedup, media, mixing, near_dedup, packing, quality_rules, token_counts, toxicity, url_filter
from .common import read

#: The vocabulary of op6; see token_path().
VOCABULARY = "word_bpe_49k.json"
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def token_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_path(), 2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_near_dedup, op3_mixing, op4_url_filter, op5_html_text, op6_token_counts, op7_line_dedup, op8_media, op9_toxicity, op10_quality_rules)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.SQL, "op7_line_dedup": line_dedup.SQL}
