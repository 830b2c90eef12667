"""The queries of this package, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import bpe, ctw, decontaminate, html_extract, license_scan, minhash, quality_crf, substring_dedup, syncmers, url_reputation

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.classify(docs, quality_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op5_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_html_extract, op3_license_scan, op4_quality_crf, op5_ctw_score, op6_bpe, op7_decontaminate, op8_url_reputation, op9_syncmers, op10_minhash)}
ORACLE_SQL: dict[str, str] = {"op7_decontaminate": decontaminate.sql(), "op8_url_reputation": url_reputation.sql()}
