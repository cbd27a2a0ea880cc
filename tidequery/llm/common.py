"""Shared parts: the shared folder for cut lineage, Arrow batches, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder for cut lineage: the one that the session names, else one under the warehouse, which executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tidequery_cut"


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there; a lost executor loses none of it. It stays dealt as it is."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like durable(), as parquet: for loops, where the plans' size estimates would grow with each round, as a checkpoint keeps its plan's."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/tidequery_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | object) -> DataFrame:
    """df.mapInArrow(run, schema), where executors get this package's code from the driver, so it needn't be installed there."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_tidequery_shipped", False):
        root = Path(__file__).resolve().parent.parent
        code = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="tq-code-"), "tidequery_code.zip"))
        with zipfile.ZipFile(code, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(code)
        sc._tidequery_shipped = True
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None where it is null."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text at most; a longer text is a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum([len(x) if x else 0 for x in texts(b, column)]) if b.nbytes > most else np.zeros(b.num_rows)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the components of the pairs (i, j): label[x] becomes the least index of x's component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): a row (node, root) for each node, root its component's least node.

    Rounds of large and small stars: a round sends each neighbour to the least of its neighbourhood, so the number of
    rounds grows with the logarithm of the number of nodes. All stays distributed; each round is cut by a checkpoint.
    Self-loops give a node alone. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = now.where("u = v").select(F.col("u").alias("node"))
    now, before = now.where("u <> v"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).unionByName(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
