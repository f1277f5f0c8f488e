"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import sql
from umbra.llm.common import table
from umbra.llm.exact_dedup import exact_dedup
from umbra.llm.html_extract import extract_pages
from umbra.llm.merge_dropout import encode_and_check
from umbra.llm.near_dedup import near_dedup
from umbra.llm.packing import pack_documents
from umbra.llm.quality_rules import judge_documents
from umbra.llm.sharding import shard_by_bytes
from umbra.llm.token_counts import length_histogram, token_lengths
from umbra.llm.url_filters import filter_urls
from umbra.llm.warc import build_derivatives, response_records


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=3, percent=85)


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(response_records(table(spark, sf_dir, "pages")))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": _op1,
        "op2_best_fit_packing": _op2,
        "op3_merge_dropout": _op3,
        "op4_minhash": _op4,
        "op5_warc_derivatives": _op5,
        "op6_sharding": _op6,
        "op7_token_counts": _op7,
        "op8_url_filters": _op8,
        "op9_quality_rules": _op9,
        "op10_html_extraction": _op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": sql.OP1,
        "op6_sharding": sql.OP6,
        "op8_url_filters": sql.OP8,
        "op9_quality_rules": sql.OP9,
    }
