"""Parquet tables of a directory as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES[:8]) -> None:
    """Registers each named table of sf_dir as a temporary view of that name."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
