"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answers, evidence, fields, flow, lists, models, more, outside, relevance, results, risk, stored, texts

_PARTS = (texts, lists, models, fields, risk, flow, more, relevance, results, answers, evidence, outside, stored)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.pol_filter_types(spark, sf_dir)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
