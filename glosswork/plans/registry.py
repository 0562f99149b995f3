"""All queries over the reference tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import facts_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (text_queries, table_queries, facts_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["chk_style_pass"](spark, sf_dir)
