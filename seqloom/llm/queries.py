"""The queries ``opN_<name>`` over the driver's tables, each a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.classifier import quality_scores
from seqloom.llm.exact_dedup import exact_dedup
from seqloom.llm.html_text import page_texts
from seqloom.llm.mixing import mix
from seqloom.llm.packing import pack
from seqloom.llm.quality_rules import quality_rules
from seqloom.llm.secrets import secret_spans
from seqloom.llm.shared import documents
from seqloom.llm.simhash import near_duplicates
from seqloom.llm.token_counts import token_counts
from seqloom.llm.warc import archived
from seqloom.session import ship_package


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_counts(documents(spark, sf_dir), tokenizer_path())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_spans(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return page_texts(documents(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(documents(spark, sf_dir), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(documents(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_html_text, op4_simhash, op5_exact_dedup, op6_packing, op7_quality_classifier, op8_mixing, op9_warc, op10_quality_rules)}
