"""Queries over the driver's tables and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrain.plans import audits, basic, composite, forecasts, loads, mdm, more, rules_queries, serving, source_queries, text_queries, window_queries

MODULES = (window_queries, basic, text_queries, rules_queries, composite, more, forecasts, loads, serving, mdm, audits, source_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_queries.latest_status(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
