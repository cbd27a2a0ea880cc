"""Session settings that the engine, the tests and the benchmark share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "tidequery", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and quoted identifiers; conf adds to it (dots as double underscores)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
