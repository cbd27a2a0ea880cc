"""SimHash near-dedup: 64-bit fingerprints, compared in vertical bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import components, durable, hooked, mapped, slices, texts

#: Members of a bucket that one comparison takes from each side; larger buckets are split into pairs of such blocks.
BLOCK = 4096
#: Groups up to this size are compared pair by pair, many groups at once.
SMALL = 48


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, some at a time: cut at white space after about `size` bytes."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        yield text[at:to].split()
        at = to


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half of the XXH64 (seed 42) of its word shingles."""
    import xxhash

    if not text:
        return 0
    digest, total, ones, carry = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for words in _words(text.lower()):
        words = carry + words
        if len(words) >= shingle:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - shingle].tolist()]
            hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carry = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total and carry:
        return digest(b" ".join(carry), 42)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """A row (doc_id, fp: long) for each row of docs. A null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(few, run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: bit k of word w of plane p is bit p of fps[64 w + k]; missing members are zero."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close(diff: Callable[[int], np.ndarray], radius: int) -> np.ndarray | None:
    """The bits set where at most `radius` of the 64 difference planes are 1; None once a block has no such bit left.

    diff(p) is plane p of the differences. Three planes at a time go through a carry-save adder into a counter of three
    bit planes; a count beyond 7 stays marked.
    """
    if not 0 <= radius <= 7:
        raise ValueError("a radius of 0 to 7")

    def beyond() -> np.ndarray:
        more, same = over.copy(), ~np.zeros_like(over)
        for count, bit in ((fours, 4), (twos, 2), (ones, 1)):
            if radius & bit:
                same &= count
            else:
                more |= same & count
                same &= ~count
        return more

    first = diff(63)
    ones, twos, fours, over = first.copy(), np.zeros_like(first), np.zeros_like(first), np.zeros_like(first)
    for p in range(0, 63, 3):
        a, b, c = diff(p), diff(p + 1), diff(p + 2)
        x = a ^ b
        one, two = x ^ c, (a & b) | (x & c)
        carry = ones & one
        ones = ones ^ one
        y = twos ^ carry
        four = (twos & carry) | (y & two)
        twos = y ^ two
        over = over | (fours & four)
        fours = fours ^ four
        if p % 12 == 9 and not (~beyond()).any():
            return None
    return ~beyond()


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs left[k], right[k] differ in at most `radius` bits."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 15):
        x = left[at : at + (1 << 15)] ^ right[at : at + (1 << 15)]
        d = planes(x)
        if (bits := close(lambda p: d[p], radius)) is not None:
            out[at : at + len(x)] = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little")[: len(x)]
    return out


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Least member of each member's component, over left followed by right; only left with right is compared, or left with itself if right is None."""
    n = len(left)
    other, base = (left, 0) if right is None else (right, n)
    d, label = planes(other), np.arange(n if right is None else n + len(right))
    for at in range(0, n, 64):
        rows = left[at : at + 64]
        mine = np.where((rows[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        bits = close(lambda p: d[p][None, :] ^ mine[:, p][:, None], radius)
        if bits is not None:
            i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, : len(other)])
            label = hooked(label, i + at, j + base)
    return label


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows that come sorted by gid, some groups at a time."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        new = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
        whole = int(np.searchsorted(held["gid"], held["gid"][-1])) if len(held["gid"]) else 0
        if whole:
            yield {k: v[:whole] for k, v in held.items()}
            held = {k: v[whole:] for k, v in held.items()}
    if held is not None and len(held["gid"]):
        yield held


def _compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            fps, gid, side = g["fp"].astype(np.int64).view(np.uint64), g["gid"], g["side"]
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            sizes = np.diff(np.r_[starts, len(gid)])
            label = np.arange(len(gid))
            of = np.repeat(sizes, sizes)
            small = of <= SMALL
            pairs = []
            for s in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
                k = np.flatnonzero(small[:-s] & (gid[s:] == gid[:-s]))
                pairs.append(np.stack([k, k + s]))
            if pairs and (ij := np.concatenate(pairs, axis=1)).size:
                i, j = ij
                apart = (side[i] != side[j]) | (side[i] == 2)
                i, j = i[apart], j[apart]
                ok = close_pairs(fps[i], fps[j], radius)
                label = hooked(label, i[ok], j[ok])
            for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                own, half = fps[at : at + n], side[at : at + n]
                if (half == 2).any():
                    label[at : at + n] = at + linked(own, None, radius)
                else:
                    order = np.argsort(half, kind="stable")
                    cut = int((half == 0).sum())
                    got = linked(own[order[:cut]], own[order[cut:]], radius)
                    label[at + order] = at + order[got]
            tied = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[label[tied]].view(np.int64))], names=["a", "b"])

    return run


def links(classes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join what lies within `radius` differing bits.

    radius + 2 bands of bits: two fingerprints within the radius agree in two bands at least, so every pair of bands is a
    bucket key. Each comparison emits a forest, not all pairs. A bucket of more than `block` members is cut into blocks
    and each pair of blocks is a group of its own, so no task gets a whole hot bucket.
    """
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    band = lambda k: f"(shiftrightunsigned(fp, {cuts[k]}) & {(1 << (cuts[k + 1] - cuts[k])) - 1}L)"
    wide = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    keys = [f"(shiftleft({c}L, {2 * wide}) | shiftleft({band(i)}, {wide}) | {band(j)})" for c, (i, j) in enumerate(combinations(range(n), 2))]
    rows = classes.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = rows.join(shared, "key").select("key", "fp", F.expr(f"cast(ceil(m / {block}) as int)").alias("nb"))
    met = met.withColumn("bl", F.expr("cast(pmod(xxhash64(fp), nb) as int)"))
    met = met.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    group = "xxhash64(key, least(bl, o), greatest(bl, o))"
    met = met.select(F.expr(group).alias("gid"), "fp", F.expr("case when bl = o then 2 when bl < o then 0 else 1 end").alias("side"))
    return mapped(met.repartition("gid").sortWithinPartitions("gid"), _compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """A row (doc_id, fp: long, component_id: long) for each row of docs.

    Documents link if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id reachable
    by links. Equal fingerprints are one class and are compared once. Texts without words (null, empty, white space) have
    fingerprint 0 and link like any other. Repeated rows each give a row. A null doc_id takes part but is never the
    smallest (component_id is null where a component has no other). An empty table gives an empty result. Other columns
    are ignored.
    """
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = durable(components(links(classes, radius, block)))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    from tidequery.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
