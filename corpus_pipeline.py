"""The corpus pipeline: stages over documents, each written and read again, each built on one operator of tidequery.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidequery.llm import decontam, langid, line_dedup, mixing, simhash
from tidequery.llm.common import durable, table

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose n-grams are this much less likely in their language than by chance (mean of the logarithms) are in none. Of
#: documents held out of the learning, the worst (80 characters, half of them digits) has -0.43; Cyrillic text has -3.4.
GAIN = -1.0


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and _row, a key of the id and the text: each row is judged by itself, equal rows alike."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("_row"))


def _kept(rows: DataFrame, keys: DataFrame, bad: bool) -> DataFrame:
    """rows with (or, if bad, without) a key of keys."""
    return rows.join(keys.select("_row").distinct(), "_row", "left_anti" if bad else "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no learned language: without text or letters, or with a gain below GAIN. The model learns from these documents. If they name no language at all, nothing can be told and all stay."""
    model = langid.learned(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    rows = _rows(docs)
    said = langid.predict(rows, model, id_col="_row")
    out = said.where((F.col("lang_pred") == langid.UND) | (F.col("gain") < GAIN)).select(F.col("doc_id").alias("_row"))
    return _kept(rows, out, bad=True).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines, with source as the host. A document of which nothing but white space is left goes if it lost a line."""
    rows = docs.select(*COLUMNS).withColumn("_lines", F.split("text", "\n"))
    out = line_dedup.drop_boilerplate(rows, "source", "_lines", "_kept")
    changed = F.size("_kept") < F.size("_lines")
    text = F.when(changed, F.array_join("_kept", "\n")).otherwise(F.col("text"))
    out = out.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), changed.alias("_changed"))
    return out.where(~F.coalesce(F.col("_changed"), F.lit(False)) | F.col("text").rlike(r"\S")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the least doc_id (null ids last), of rows with that id but other texts one, of equal rows one."""
    rows = _rows(docs)
    found = simhash.near_duplicates(rows, id_col="_row").groupBy(F.col("doc_id").alias("_row")).agg(F.count("*").alias("n"), F.min("component_id").alias("group"))
    named = rows.select("_row", "doc_id").distinct().join(found, "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "n"))
    firsts = durable(named.groupBy("group").agg(first.alias("f")).select("f._row", "f.n"))
    kept = _kept(rows, firsts, bad=False)
    if firsts.where("n > 1").isEmpty():
        return kept.select(*COLUMNS)
    one = kept.groupBy("_row").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("d"))
    return one.select(*(F.col(f"d.{c}").alias(c) for c in COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of a benchmark item."""
    rows = _rows(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return _kept(rows, found.where("n_hit > 0").select(F.col("doc_id").alias("_row")), bad=True).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities calibrated to target weights; adds topic, tokens, weight and probability."""
    out = mixing.mixed(docs.select(*COLUMNS))
    return out.select(*COLUMNS, F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_p", 6).alias("p"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: SQL can't express the learned language model, SimHash's XXH64 or the fitted sample; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
