"""The query catalogue of the reference's own operators: Spark callables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidequery.plans.engine_queries import ENGINE, viewed
from tidequery.plans.reads_sql import READS


def _runner(sql: str, params: tuple) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: viewed(spark, sf_dir).frame(sql, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _runner(v[0], v[2]) for k, v in READS.items()} | {k: v[0] for k, v in ENGINE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] or v[0] for k, v in READS.items()} | {k: v[1] for k, v in ENGINE.items()}
