"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_binary import token_binary

    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def mixing_targets():
    """Production parameters of the mixing query."""
    from .mixing import OTHER, Targets

    return Targets(languages={"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.13, OTHER: 0.02}, topics={"prose": 0.7, "license": 0.1, "tables": 0.05, "symbols": 0.05, "secrets": 0.02, OTHER: 0.08})


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), mixing_targets())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg_audio import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import perplexity

    return perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), across=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_binary, op2_mixing, op3_warc, op4_toxicity, op5_html_extract, op6_simhash, op7_mpeg_audio, op8_language, op9_kneser_ney, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    from .mixing import oracle

    return {"op2_mixing": oracle(mixing_targets())}
