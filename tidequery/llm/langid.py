"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import durable, mapped, slices, table

ORDERS = (1, 2, 3, 4)
BITS = 15
#: Code points of a text that are hashed at once.
PIECE = 1 << 17
UND = "und"
#: Languages of a part of the model: 4 bytes for each of them and each bucket are broadcast at a time.
LANGS = 256


def buckets(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a lower-cased text, in pieces of bounded size."""
    text, most = text.lower(), max(orders)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h, size = np.zeros(len(c), np.uint32), min(PIECE, len(text) - at)
        for n in range(1, most + 1):
            h = h[: max(0, len(c) - n + 1)] * np.uint32(0x9E3779B1) + c[n - 1 :]
            if n in orders:
                yield ((h[:size] + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def _grams(texts: list[str | None], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of texts (from, to) with a batch of buckets: short texts are hashed together, where n-grams end with their text.

    The third item holds the buckets and the ends of each text of the run in them.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= PIECE):
            size += len(texts[to] or "")
            to += 1
        yield at, to, texts[at:to]
        at = to


def _hashed(run: list[str | None], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, starts of each text among them) for each order; buckets of n-grams over a text's end are 1 << bits."""
    lowered = [(t or "").lower() for t in run]
    ends = np.cumsum([len(t) for t in lowered])
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(orders) + 1):
        h = h[: max(0, len(c) - n + 1)] * np.uint32(0x9E3779B1) + c[n - 1 :]
        if n in orders:
            out = np.full(len(c), 1 << bits, np.uint32)
            out[: len(h)] = ((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
            for k in range(1, n):
                cut = ends - k
                out[cut[cut >= 0]] = 1 << bits
            yield out, ends


def sums(texts: list[str | None], matrix: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """For each text the sum of the matrix rows of its n-grams. matrix: (1 << bits) + 1 rows, the last one zero."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for at, to, run in _grams(texts, bits, orders):
        if to == at + 1 and len(run[0] or "") > PIECE:
            for b in buckets(run[0], bits, orders):
                out[at] += matrix[b].sum(axis=0, dtype=np.float64)
            continue
        for b, ends in _hashed(run, bits, orders):
            starts = np.r_[0, ends[:-1]]
            full = np.flatnonzero(ends > starts)
            if len(full):
                out[at + full] += np.add.reduceat(matrix[b], starts[full], axis=0, dtype=np.float64)
    return out


@dataclass
class Part:
    """Some languages in order, and a (1 << bits) + 1 by len(langs) matrix of log-probabilities with a last row of zeros; prior: log-shares of texts."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray


class Model:
    """All languages in order, with their texts and n-grams; the counts stay a table, of which a part of the languages is read at a time."""

    def __init__(self, rows: DataFrame, bits: int, orders: tuple[int, ...], alpha: float, block: int) -> None:
        found = sorted((r.lang, r.texts, r.grams) for r in rows.groupBy("lang").agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("texts"), F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).alias("grams")).collect())
        self.langs = [x[0] for x in found]
        self._texts, self._grams = (np.array([x[k] for x in found], float) for k in (1, 2))
        self._rows, self.bits, self.orders, self._alpha, self._block = rows, bits, orders, alpha, block

    def parts(self) -> Iterator[Part]:
        """The languages, `block` at a time: a part has as many counts as languages and buckets at most."""
        for at in range(0, len(self.langs), self._block):
            langs = self.langs[at : at + self._block]
            rows = self._rows.where(F.col("lang").isin(langs) & (F.col("bucket") >= 0)).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).toArrow()
            matrix = np.zeros(((1 << self.bits) + 1, len(langs)))
            for lang, own in zip(rows.column("lang").to_pylist(), rows.column("c"), strict=True):
                matrix[own.values.field("bucket").to_numpy(), langs.index(lang)] = own.values.field("n").to_numpy()
            matrix[:-1] = np.log((matrix[:-1] + self._alpha) / (self._grams[at : at + self._block] + self._alpha * (1 << self.bits)))
            matrix[-1] = 0
            yield Part(langs, matrix.astype(np.float32), np.log(self._texts[at : at + self._block] / self._texts.sum()))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, orders: tuple[int, ...] = ORDERS, alpha: float = 0.5, block: int = LANGS) -> Model:
    """A model from all rows with a text and a language. Each task adds up its own counts; their sums are bounded by languages x buckets.

    Texts of any length and number of languages are fine; an empty table gives a model of no language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            found = []
            for lang, own in counts.items():
                own[-1] = 0
                k = np.flatnonzero(own)
                found.append(([lang] * (len(k) + 1), np.r_[k, -1], np.r_[own[k], docs[lang]]))
            counts.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[0]], pa.string()), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["lang", "bucket", "n"])

        for b in slices(batches, most=1 << 20):
            ts, ls = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in set(ls):
                own = counts.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                mine = [t for t, x in zip(ts, ls, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(mine)
                for _, _, part in _grams(mine, bits, orders):
                    found = buckets(part[0], bits, orders) if len(part) == 1 else (x for x, _ in _hashed(part, bits, orders))
                    for x in found:
                        own += np.bincount(x, minlength=(1 << bits) + 1)
                if len(counts) >= block:
                    yield told()
        if counts:
            yield told()

    few = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = durable(mapped(few, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return Model(rows, bits, orders, alpha, block)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, lang_pred, score, gain) for each row of docs; score is the posterior probability of lang_pred.

    gain: how much likelier an n-gram of the text is in that language than if all buckets were equally likely, the mean of
    the logarithms; it is over 0 for texts that look like a learned language. The posterior can't tell: of languages that
    all don't fit, one is still far likelier than the others.
    A text that is null or has no letter, and any text if the model knows no language, is `und` with score 0 and gain 0.
    Of equal posteriors the first language in order is taken. Repeated rows each give a row; an empty table gives an empty
    result; other columns are ignored. The documents are read once for each block of languages (LANGS) of the model.
    """
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(UND).alias("lang_pred"), F.lit(-math.inf).alias("best"), F.lit(-math.inf).alias("total"), F.lit(0.0).alias("gain"))
    spark, bits, orders = docs.sparkSession, model.bits, model.orders

    def judge(now: DataFrame, part: Part) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in slices(batches, most=1 << 20):
                ts = [t if t and any(map(str.isalpha, t)) else None for t in b.column("text").to_pylist()]
                said, best, total, gain = b.column("lang_pred").to_pylist(), *(b.column(c).to_numpy().copy() for c in ("best", "total", "gain"))
                lengths = np.array([len(t.lower()) if t else 0 for t in ts])
                grams = sum(np.maximum(lengths - n + 1, 0) for n in orders)
                plain = sums(ts, m.matrix, bits, orders)
                s = plain + m.prior
                k = s.argmax(axis=1)
                top = s[np.arange(len(ts)), k]
                own = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
                told = np.array([t is not None for t in ts], bool)
                better = told & (top > best)
                total = np.where(told, np.logaddexp(total, own), total)
                gain = np.where(better, plain[np.arange(len(ts)), k] / np.maximum(grams, 1) + bits * math.log(2), gain)
                best = np.where(better, top, best)
                said = [m.langs[j] if y else x for x, y, j in zip(said, better.tolist(), k.tolist(), strict=True)]
                new = {"lang_pred": pa.array(said, pa.string()), "best": pa.array(best, pa.float64()), "total": pa.array(total, pa.float64()), "gain": pa.array(gain, pa.float64())}
                yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

        return mapped(now, run, now.schema)

    for k, part in enumerate(model.parts()):
        few = judge(durable(few) if k else few, part)
    return few.select("doc_id", "lang_pred", F.when(F.col("total") > -math.inf, F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total")))).otherwise(0.0).alias("score"), "gain")


#: Whether a document is held out of the learning.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)"


def learned(docs: DataFrame) -> Model:
    """The model of all documents that are not held out and name their language."""
    return fit(docs.where(f"doc_id is not null and not {HELD_OUT}"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = predict(docs, learned(docs))
    return said.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")
