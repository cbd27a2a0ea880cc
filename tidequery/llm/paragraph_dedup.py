"""Substring dedup: paragraphs that nearly repeat, found by MinHash bands, verified by exact Jaccard, clustered."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidequery.llm.common import components, durable, hooked, mapped, slices, table, texts
from tidequery.llm.decontam import Words, _spans, words_of

SHINGLE, THRESHOLD, RECALL, MIN_WORDS = 5, 0.8, 0.9995, 20
#: Least words of a passage.
PASSAGE = 50
#: Rows of a band; bands of the first round; members of a bucket that a comparison takes from each side.
ROWS, FIRST, BLOCK = 5, 4, 1024
#: Classes whose shingles are picked by a broadcast array (8 bytes each); more are picked by a join.
BROADCAST = 1_000_000
_MIX = 0xD6E8FEB86659FD93


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of `rows` values in which a pair at the threshold meets with probability `recall` at least."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _classes(w: Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _mixed(_spans(w.hashes, start, stop, 0xBF58476D1CE4E5B9, pow(0xBF58476D1CE4E5B9, -1, 1 << 64)) + (stop - start).astype(np.uint64)).view(np.int64)


class Windows:
    """All runs of `size` words of a batch of texts, over line ends too: text, first word in the batch, class and seed.

    The seed is the least hash of the runs of half the words inside, so equal windows have equal seeds, and neighbours
    mostly share theirs.
    """

    def __init__(self, batch: list[bytes | None], size: int) -> None:
        self.size, self.w = size, words_of(batch)
        n = np.maximum(np.diff(self.w.first) - size + 1, 0)
        self.text = np.repeat(np.arange(len(batch)), n)
        self.at = np.arange(len(self.text)) + np.repeat(self.w.first[:-1] - (np.cumsum(n) - n), n)
        self.begins = np.diff(self.text, prepend=-1) != 0
        self._batch = batch

    def seeds(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, np.uint64)
        half = (self.size + 1) // 2
        low, have, most = _mixed(self.w.grams(half)), 1, self.size - half + 1
        while have < most:
            step = min(have, most - have)
            low, have = np.minimum(low[:-step], low[step:]), have + step
        return _mixed(low[self.at] * np.uint64(_MIX))

    def runs(self) -> np.ndarray:
        """The seed of each run of windows with one seed; twice if the run is longer than one place of the seed can make it."""
        seed = self.seeds()
        first = np.flatnonzero(self.begins | (np.diff(seed, prepend=np.uint64(0)) != 0))
        long_ = np.diff(np.r_[first, len(seed)]) > self.size - (self.size + 1) // 2 + 1
        return np.r_[seed[first], seed[first[long_]]].view(np.int64)

    def classes(self) -> np.ndarray:
        return _classes(self.w, self.at, self.at + self.size)

    def apart(self, chosen: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The chosen windows without those that overlap one of their own class before them in their text."""
        order = np.lexsort((self.at[chosen], cls[chosen], self.text[chosen]))
        x = chosen[order]
        same = (np.diff(self.text[x], prepend=-1) == 0) & (np.diff(cls[x], prepend=0) == 0)
        if not (same & (np.diff(self.at[x], prepend=0) < self.size)).any():
            return chosen
        keep, last = np.ones(len(x), bool), 0
        for k, (again, at) in enumerate(zip(same.tolist(), self.at[x].tolist(), strict=True)):
            if again and at - last < self.size:
                keep[k] = False
            else:
                last = at
        return np.sort(x[keep])

    def lines(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line in the text, first word in the line, words of the line, class of the line) where the chosen windows start."""
        joined = np.frombuffer(b"\0".join(t or b"" for t in self._batch) + b"\0", np.uint8)
        base = np.cumsum([0, *(len(t or b"") + 1 for t in self._batch)])
        ends = np.flatnonzero((joined == 0x0A) | (joined == 0))
        line = np.searchsorted(ends, self.w.starts[self.at[chosen]])
        cuts = np.r_[0, np.searchsorted(self.w.starts, ends)]
        place = line - np.searchsorted(ends, base[self.text[chosen]])
        return place, self.at[chosen] - cuts[line], cuts[line + 1] - cuts[line], _classes(self.w, cuts[line], cuts[line + 1])


def _released(spark) -> None:
    """Lets Spark remove the exchanges and checkpoints that nothing refers to any more; it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bitmap(classes: DataFrame) -> tuple[int, object]:
    """(bits, broadcast bitmap) of the leading bits of the classes (cls: long). It has 2^28 bits at most; those that it lets pass too are told apart by a join."""
    bits = int(min(28, max(16, np.ceil(np.log2(16 * classes.count() + 1)))))
    found = classes.selectExpr(f"shiftrightunsigned(cls, {64 - bits}) as b").groupBy(F.expr("shiftrightunsigned(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    return bits, classes.sparkSession.sparkContext.broadcast(out)


def _marked(x: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Which of the classes x may be in the bitmap."""
    at = x.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class Paragraphs:
    """The paragraphs (lines) of a batch of texts with min_words words at least: text, place in it, words, class and shingle hashes."""

    def __init__(self, batch: list[bytes | None], shingle: int, min_words: int) -> None:
        lines = [(t or b"").split(b"\n") for t in batch]
        w: Words = words_of([x for own in lines for x in own])
        n = np.diff(w.first)
        at = np.flatnonzero(n >= max(1, min_words))
        count = np.array([len(x) for x in lines], np.int64)
        base = np.cumsum(count) - count
        self.text = np.repeat(np.arange(len(batch)), count)[at]
        self.place = at - base[self.text] if len(at) else at
        self.n = n[at]
        self.cls = _classes(w, w.first[at], w.first[at + 1])
        k = np.minimum(n[at], shingle)
        size = self.n - k + 1
        ends = np.cumsum(size)
        self.starts = ends - size
        word = np.repeat(w.first[at] - self.starts, size) + np.arange(ends[-1] if len(at) else 0)
        span = np.repeat(k, size)
        self.shingles = _mixed(_spans(w.hashes, word, word + span, _MIX, pow(_MIX, -1, 1 << 64)))

    def keys(self, chosen: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """Bucket keys of the chosen paragraphs, one column a band."""
        size = np.diff(np.r_[self.starts, len(self.shingles)])[chosen]
        starts = np.cumsum(size) - size
        x = self.shingles[np.repeat(self.starts[chosen] - starts, size) + np.arange(size.sum())]
        r = np.random.default_rng(61)
        a, b = (r.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        out = np.zeros((len(chosen), bands), np.uint64)
        for k in range(bands * rows):
            v = (x * a[k] + b[k]) ^ (x >> np.uint64(31))
            out[:, k // rows] = _mixed(out[:, k // rows] + np.minimum.reduceat(v, starts))
        return _mixed(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_MIX)).view(np.int64)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def _compare(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of groups that come sorted by gid. A pair is verified only while its two are in different components, so a group of copies of one another costs one comparison each."""

    def forest(group: list[tuple]) -> Iterator[tuple[int, int]]:
        cls, side = np.array([x[1] for x in group], np.int64), np.array([x[3] for x in group])
        sets = [np.frombuffer(x[4], np.uint64) for x in group]
        size = np.array([len(s) for s in sets])
        label = np.unique(np.array([x[2] for x in group], np.int64), return_index=True, return_inverse=True)
        label = label[1][label[2]]
        for i in range(len(group)):
            later = np.arange(i + 1, len(group))
            later = later[(label[later] != label[i]) & ((side[later] != side[i]) | (side[later] == 2)) & (np.minimum(size[later], size[i]) >= threshold * np.maximum(size[later], size[i]))]
            for j in later.tolist():
                if label[i] != label[j] and _jaccard(sets[i], sets[j]) >= threshold:
                    label = hooked(label, np.array([i]), np.array([j]))
                    yield int(cls[i]), int(cls[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(b.column(n).to_pylist() for n in ("gid", "cls", "root", "side", "shingles")), strict=True):
                if held and held[0][0] != row[0]:
                    out += forest(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        if held:
            out = list(forest(held))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, paragraph, first_word, n_words, cls, inside) of the passages, and (a, b) where passage a is the whole line of class b.

    A window of `passage` words that occurs again is joined with the next one if all copies of the one go on with the
    other and all copies of the other come from the one; a passage is what is so joined. Windows are first picked by
    their seeds, in a bitmap that can let more pass but loses none; then counted by class, with the least and greatest of
    their neighbours; only the first and last windows of passages are joined with their texts.
    """

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(Windows(texts(b), passage).runs())], names=["cls"])

    seeds = durable(mapped(docs, seeded, "cls long").groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"))
    seed_bits, seed_map = _bitmap(seeds)

    def edged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            x = Windows(texts(b), passage)
            cls, chosen = x.classes(), np.flatnonzero(_marked(x.seeds(), seed_bits, seed_map.value))
            before = np.where(x.begins, 0, np.r_[0, cls[:-1]] if len(cls) else cls)
            after = np.where(np.r_[x.begins[1:], True], 0, np.r_[cls[1:], 0]) if len(cls) else cls
            yield pa.RecordBatch.from_arrays([pa.array(y[chosen]) for y in (cls, before, after)], names=["cls", "before", "after"])

    ends = [f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("lo", F.min), ("hi", F.max))]
    known = durable(mapped(docs, edged, "cls long, before long, after long").groupBy("cls").agg(F.count("*").alias("n"), *ends).where("n > 1"))
    _released(docs.sparkSession)
    counts = known.select(F.col("cls").alias("other"), F.col("n").alias("m"))

    def outer(side: str, kind: int) -> DataFrame:
        """Classes that the window on that side is not joined with."""
        sole = F.col(f"{side}_lo") == F.col(f"{side}_hi")
        far = known.where(sole).join(counts, (F.col(f"{side}_lo") == F.col("other")) & (F.col("n") == F.col("m")), "left_anti")
        return known.where(~sole).select("cls").unionByName(far.select("cls")).withColumn("kind", F.lit(kind))

    kinds = durable(outer("before", 1).unionByName(outer("after", 2)).groupBy("cls").agg(F.sum("kind").alias("kind")))
    del known, counts
    _released(docs.sparkSession)
    kind_bits, kind_map = _bitmap(kinds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, most=1 << 20):
            x = Windows(texts(b), passage)
            cls, chosen = x.classes(), np.flatnonzero(_marked(x.seeds(), seed_bits, seed_map.value))
            chosen = x.apart(chosen[_marked(cls[chosen], kind_bits, kind_map.value)], cls)
            place, first, n, line = x.lines(chosen)
            text = x.text[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(row + text), b.column("doc_id").take(pa.array(text)), pa.array(x.at[chosen]), pa.array(place.astype(np.int32)), pa.array(first), pa.array(n), pa.array(line), pa.array(cls[chosen])], names=["row", "doc_id", "at", "paragraph", "first_word", "line_words", "line", "cls"])
            row += b.num_rows

    found = durable(mapped(docs, placed, "row long, doc_id long, at long, paragraph int, first_word long, line_words long, line long, cls long"))
    later = Window.partitionBy("row").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.coalesce(F.last(F.when(F.col("kind") >= 2, F.col("at")), ignorenulls=True).over(later), F.col("at"))
    runs = found.join(kinds, "cls").withColumn("n_words", stop - F.col("at") + passage).where("kind <> 2")
    runs = durable(runs.withColumn("whole", F.expr(f"first_word = 0 and n_words = line_words and line_words >= {max(1, min_words)}")))
    inner = runs.where("not whole").select("doc_id", "paragraph", "first_word", "n_words", "cls", F.expr("first_word + n_words <= line_words").alias("inside"))
    return inner, runs.where("whole").select(F.col("cls").alias("a"), F.col("line").alias("b")).distinct()


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS, recall: float = RECALL, block: int = BLOCK, broadcast: int = BROADCAST, passage: int = PASSAGE) -> DataFrame:
    """A row for each paragraph or passage that repeats: (doc_id, paragraph, first_word, n_words, cluster_doc_id, cluster_paragraph, members, removed).

    A paragraph is a line with min_words words (runs of letters and digits, A-Z in lower case) at least. A passage is a
    longest run of `passage` words at least, wherever it starts and over line ends too, that occurs again with equal
    words; where a run's copies go different ways it is cut, and its parts overlap by passage - 1 words. paragraph and
    first_word are the line and the place in it where it starts; n_words counts on over line ends. first_word is 0 for a
    paragraph. A passage inside a line that is marked removed has no row; one that is a whole paragraph is that
    paragraph. Of copies that overlap in a text the first counts. Equal ones are
    one class; paragraphs link if the Jaccard similarity of their sets of `shingle`-word shingles is `threshold` or more,
    and clusters are the components of links. The first member (least doc_id, then place) stays and names the cluster; the
    others are marked removed. What repeats nowhere has no row.
    Bands are tuned so that a pair at the threshold shares a bucket with probability `recall`. Pairs are compared only
    inside a bucket, in blocks, while they are in different components; a second round of bands takes only the buckets
    that the first left in several components.
    Null and empty texts have no paragraphs. A repeated row's paragraphs are members of their own; a null doc_id comes
    first. An empty table gives an empty result; other columns are ignored.
    """
    spark, bands = docs.sparkSession, bands_for(threshold, recall)
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            p = Paragraphs(texts(b), shingle, min_words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(p.text)), pa.array(p.place.astype(np.int32)), pa.array(p.n.astype(np.int64)), pa.array(p.cls)], names=["doc_id", "paragraph", "n_words", "cls"])

    def fresh(p: Paragraphs, seen: set) -> np.ndarray:
        """Paragraphs whose class this task has not had lately."""
        if len(seen) > 200_000:
            seen.clear()
        first = np.sort(np.unique(p.cls, return_index=True)[1])
        chosen = np.array([k for k in first.tolist() if p.cls[k] not in seen], np.int64)
        seen.update(p.cls[chosen].tolist())
        return chosen

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in slices(batches, most=1 << 20):
            p = Paragraphs(texts(b), shingle, min_words)
            if len(chosen := fresh(p, seen)):
                keys = p.keys(chosen, bands, ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), pa.array(np.tile(p.cls[chosen], bands)), pa.array(np.repeat((np.arange(bands) >= FIRST).astype(np.int32), len(chosen)))], names=["key", "cls", "late"])

    members = durable(mapped(few, listed, "doc_id long, paragraph int, n_words long, cls long"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = mapped(few, banded, "key long, cls long, late int").repartition(parts, "key")
    several = dealt.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.max("late").alias("l")).where("lo <> hi and l >= 0").select("key")
    met = durable(dealt.join(several, "key").distinct())
    del dealt, several
    _released(spark)
    wanted = met.select("cls").distinct()
    few_enough = wanted.count() <= broadcast
    picked = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("cls").to_numpy()) if few_enough else None)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in slices(batches, most=1 << 20):
            p = Paragraphs(texts(b), shingle, min_words)
            chosen = fresh(p, seen)
            if picked.value is not None and len(chosen):
                chosen = chosen[_among(p.cls[chosen], picked.value)]
            ends = np.r_[p.starts, len(p.shingles)]
            found = [np.unique(p.shingles[ends[k] : ends[k + 1]]).tobytes() for k in chosen.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(p.cls[chosen]), pa.array(found, pa.binary())], names=["cls", "shingles"])

    own = mapped(few, sets, "cls long, shingles binary")
    own = durable((own if few_enough else own.join(wanted, "cls", "left_semi")).dropDuplicates(["cls"]))
    edges, roots = None, None
    for late in (0, 1):
        rows = met.where(F.col("late") == late).select("key", "cls")
        rows = rows.withColumn("root", F.col("cls")) if roots is None else rows.join(roots, rows.cls == roots.node, "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
        open_ = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", F.expr(f"cast(ceil(m / {block}) as int)").alias("nb"))
        rows = rows.join(open_, "key").withColumn("bl", F.expr("cast(pmod(xxhash64(cls), nb) as int)")).withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
        rows = rows.select(F.expr("xxhash64(key, least(bl, o), greatest(bl, o))").alias("gid"), "cls", "root", F.expr("case when bl = o then 2 when bl < o then 0 else 1 end").alias("side"))
        dealt_out = rows.join(own, "cls").select("gid", "cls", "root", "side", "shingles").repartition("gid").sortWithinPartitions("gid")
        new = mapped(dealt_out, _compare(threshold), "a long, b long")
        edges = new if edges is None else edges.unionByName(new)
        edges = durable(edges)
        roots = durable(components(edges))
    del met, own, rows, dealt_out, new, open_, wanted
    _released(spark)
    inner, same = repeated_passages(few, passage, min_words)
    roots = durable(components(edges.unionByName(same)))
    every = members.withColumn("first_word", F.lit(0).cast("long")).select("doc_id", "paragraph", "first_word", "n_words", "cls").unionByName(inner.drop("inside"))
    named = F.col("doc_id").isNotNull().alias("named")
    classes = every.groupBy("cls").agg(F.count("*").alias("copies"), F.min(F.struct(named, "doc_id", "paragraph", "first_word")).alias("head"))
    classes = classes.join(roots, classes.cls == roots.node, "left").select("cls", "copies", "head", F.coalesce("root", "cls").alias("root"))
    clusters = classes.groupBy("root").agg(F.sum("copies").alias("members"), F.min("head").alias("head")).where("members > 1")
    marks = durable(classes.select("cls", "root").join(clusters, "root").select("cls", "members", F.col("head.doc_id").alias("cluster_doc_id"), F.col("head.paragraph").alias("cluster_paragraph"), F.col("head.first_word").alias("_first")))
    first = F.col("doc_id").eqNullSafe(F.col("cluster_doc_id")) & (F.col("paragraph") == F.col("cluster_paragraph")) & (F.col("first_word") == F.col("_first"))
    lines = members.join(marks, "cls").withColumn("first_word", F.lit(0).cast("long"))
    whole = lines.where(~first).select(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_z"), F.col("paragraph").alias("_p")).distinct()
    parts_ = inner.join(whole, F.col("inside") & (F.coalesce("doc_id", F.lit(0)) == F.col("_d")) & (F.col("doc_id").isNull() == F.col("_z")) & (F.col("paragraph") == F.col("_p")), "left_anti").join(marks, "cls").drop("inside")
    return parts_.unionByName(lines.select(*parts_.columns)).select("doc_id", "paragraph", "first_word", "n_words", "cluster_doc_id", "cluster_paragraph", "members", (~first).alias("removed"))


def op6(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))
