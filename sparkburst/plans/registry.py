"""All queries of the engine: a Spark plan each, and the DuckDB text that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_queries, curve_queries, cube_queries, run_queries, sky_queries, sql_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (cube_queries, curve_queries, sky_queries, catalogue_queries, run_queries, sql_queries):
    for _name, (_plan, _sql) in _module.REGISTER.items():
        QUERIES[_name] = _plan
        if _sql:
            ORACLE_SQL[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_bayes_peak"](spark, sf_dir)
