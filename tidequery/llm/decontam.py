"""Benchmark decontamination: a prefix-filtered join of item windows with document words, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import durable, mapped, slices, table, texts

#: Words of an item window, and of the shingles that are ordered by rarity.
WINDOW, SHINGLE = 10, 3
#: Windows that one broadcast holds; more are joined block by block.
BLOCK = 200_000

#: The lower-cased word character of each byte, 0 for the others. Word characters: digits, letters and all bytes from 128 on.
_LOWER = np.zeros(256, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_c] = _c
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        out, have = np.ones(max(n, 1 << 16), np.uint64), 1
        while have < len(out):
            step = out[: min(have, len(out) - have)]
            out[have : have + len(step)] = step * np.uint64(pow(base, have, 1 << 64))
            have += len(step)
        _POWERS[base] = out
    return _POWERS[base][:n]


def _spans(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hashes of terms[start:end], each as if it stood at place 0."""
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms * _powers(base, len(terms)), out=total[1:])
    return (total[ends] - total[starts]) * _powers(inverse, len(terms) + 1)[starts]


@dataclass
class Words:
    """The words of some texts: low-cased bytes of all texts, where each word starts and ends, its hash, and the words before each text."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def at(self, k: int, n: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[k : k + n].tolist(), self.ends[k : k + n].tolist(), strict=True))

    def grams(self, n: int, window_base: int = 0xD6E8FEB86659FD93, mixed: int = pow(0xD6E8FEB86659FD93, -1, 1 << 64)) -> np.ndarray:
        """Hashes of n words in a row, by place of the first; runs over the end of a text are included."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return _spans(self.hashes, at, at + n, window_base, mixed)


def words_of(batch: list[bytes | None]) -> Words:
    joined = np.frombuffer(b"\0".join(t or b"" for t in batch) + b"\0", np.uint8)
    low = _LOWER[joined]
    inside = (low != 0).view(np.int8)
    turns = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    hashes = _spans(low.astype(np.uint64), starts, ends, _BASE, _INVERSE)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    base = np.cumsum([0, *(len(t or b"") + 1 for t in batch)])
    return Words(low, starts, ends, hashes, np.searchsorted(starts, base))


class Lookup:
    """Places of hashes in a sorted array; most that are absent are told by one look at a table of bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bits = max(16, int(len(self.keys)).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, place): hashes[k] == keys[place], for all such k in order."""
        k = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
        place = np.searchsorted(self.keys, hashes[k])
        place[place == len(self.keys)] = 0
        ok = self.keys[place] == hashes[k] if len(self.keys) else np.zeros(len(k), bool)
        return k[ok], place[ok]


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, words: the window's words joined by a space, n) of items; a null id is dropped with its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            w = words_of(texts(b))
            ids, out = b.column("item").to_pylist(), []
            for k, item in enumerate(ids):
                a, z = int(w.first[k]), int(w.first[k + 1])
                own = w.at(a, z - a).split(b" ") if z > a else []
                out += {(item, b" ".join(own[i : i + window]), min(window, len(own))) for i in range(max(1, len(own) - window + 1))} if own else ()
            got = list(zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array([x.decode() for x in got[1]], pa.string()), pa.array(got[2], pa.int32())], names=["item", "words", "n"])

    few = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    return mapped(few, run, "item string, words string, n int").distinct()


class Index:
    """Windows by their rarest shingle: for threshold 1, that one shingle is the necessary prefix of the ordered set."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int) -> None:
        self.id = np.array([x for x, _ in rows], np.int64)
        self.words = [x.encode() for _, x in rows]
        self.n = np.array([w.count(b" ") + 1 for w in self.words], np.int64)
        w = words_of(self.words)
        self.whole = np.zeros(len(self.words), np.uint64)
        window, place, size, key = [], [], [], []
        for n in np.unique(self.n).tolist():
            s, grams, full = min(shingle, n), w.grams(min(shingle, n)), w.grams(n)
            for k in np.flatnonzero(self.n == n).tolist():
                a = int(w.first[k])
                self.whole[k] = full[a]
                span = range(n - s + 1)
                window += [k] * len(span)
                place += span
                size += [s] * len(span)
                key += grams[a : a + n - s + 1].tolist()
        self.window, self.place, self.size = (np.array(x, np.int64) for x in (window, place, size))
        self.key = np.array(key, np.uint64)
        self.sizes = sorted(set(size))

    def shingles(self) -> list[tuple[int, Lookup]]:
        return [(s, Lookup(self.key[self.size == s])) for s in self.sizes]

    def prefixes(self, counts: dict[int, int]) -> None:
        """Keeps for each window the shingle that the corpus has least often (of equal ones the first)."""
        often = np.array([counts.get(k, 0) for k in self.key.tolist()], np.int64)
        order = np.lexsort((self.place, often, self.window))
        first = order[np.flatnonzero(np.diff(self.window[order], prepend=-1))]
        self.window, self.place, self.size, self.key = self.window[first], self.place[first], self.size[first], self.key[first]
        self.by_size = []
        for s in self.sizes:
            at = np.flatnonzero(self.size == s)
            look = Lookup(self.key[at])
            slot = np.searchsorted(look.keys, self.key[at])
            by = np.argsort(slot, kind="stable")
            self.by_size.append((s, look, at[by], np.searchsorted(slot[by], np.arange(len(look.keys) + 1))))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence of a window in the words of a batch of texts."""
        found_at, found = [], []
        whole = {n: w.grams(n) for n in np.unique(self.n).tolist()}
        for s, look, members, bounds in self.by_size:
            k, slot = look.find(w.grams(s))
            reps = bounds[slot + 1] - bounds[slot]
            at = np.repeat(k, reps)
            m = members[np.repeat(bounds[slot] - np.cumsum(np.r_[0, reps[:-1]]), reps) + np.arange(reps.sum())]
            win, start = self.window[m], at - self.place[m]
            text = np.searchsorted(w.first, at, side="right") - 1
            fits = (start >= w.first[text]) & (start + self.n[win] <= w.first[text + 1])
            win, start = win[fits], start[fits]
            for n in np.unique(self.n[win]).tolist():
                mine = np.flatnonzero(self.n[win] == n)
                mine = mine[whole[n][start[mine]] == self.whole[win[mine]]]
                ok = [x for x in mine.tolist() if w.at(int(start[x]), n) == self.words[win[x]]]
                found_at.append(start[ok])
                found.append(win[ok])
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rarity(docs: DataFrame, index: Index) -> dict[int, int]:
    """How often all documents have each shingle of the windows. Each task adds up its own; as many rows as shingles at most reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(index.shingles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(look.keys), np.int64) for _, look in shared.value]
        for b in slices(batches, most=1 << 20):
            w = words_of(texts(b))
            for (s, look), own in zip(shared.value, sums, strict=True):
                own += np.bincount(look.find(w.grams(s))[1], minlength=len(own))
        for (_, look), own in zip(shared.value, sums, strict=True):
            k = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(look.keys[k].view(np.int64)), pa.array(own[k])], names=["key", "n"])

    rows = mapped(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("key").to_numpy().view(np.uint64).tolist(), rows.column("n").to_pylist(), strict=True))


def _joined(docs: DataFrame, index: Index) -> DataFrame:
    """Adds what one block of windows hits to the columns windows and spans; sets n_words."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            index, w = shared.value, words_of(texts(b))
            at, win = index.hits(w)
            text = np.searchsorted(w.first, at, side="right") - 1
            ids, spans = b.column("windows").to_pylist(), b.column("spans").to_pylist()
            for k in np.unique(text).tolist():
                mine = text == k
                ids[k] += np.unique(index.id[win[mine]]).tolist()
                s = at[mine] - w.first[k]
                spans[k] = merged(spans[k], zip(s.tolist(), (s + index.n[win[mine]]).tolist(), strict=True))
            named = {"n_words": pa.array(np.diff(w.first), pa.int64()), "windows": pa.array(ids, pa.list_(pa.int64())), "spans": pa.array(spans, b.schema.field("spans").type)}
            yield pa.RecordBatch.from_arrays([named.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

    return mapped(docs, run, docs.schema)


def merged(old: list[dict], new) -> list[dict]:
    """Spans of words in order, joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, z in sorted({*((x["a"], x["z"]) for x in old), *new}):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [{"a": a, "z": z} for a, z in out]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """A row (doc_id, n_words, items, spans, n_hit) for each row of docs.

    A window is `window` consecutive words of an item (a shorter item is one window; one without words has none). items:
    ids (as text, sorted) of the items with a window in the document. spans: places [a, z) of the document's hit words.
    The corpus orders the shingles of all windows by rarity; each window is joined by its rarest one, at the place this
    gives it, must fit in the document, and is compared word for word. The distinct windows are broadcast if there are at
    most `block`; more go block by block, each over the documents with what the blocks before found. Which items have a
    window is never broadcast or collected: it is joined with the windows that the documents have.
    Null or empty texts have no words. Repeated rows each give a row; equal items are all listed; items with a null id
    are left out; an empty table of either kind is fine; other columns are ignored.
    """
    now = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("windows"), F.expr("cast(array() as array<struct<a: bigint, z: bigint>>)").alias("spans"))
    rows = durable(windows(items, item_id, item_text, window))
    each = durable(rows.select("words").distinct().withColumn("id", F.monotonically_increasing_id()))
    blocks = max(1, -(-each.count() // block))
    for k in range(blocks):
        index = Index([tuple(r) for r in each.where(f"pmod(xxhash64(id), {blocks}) = {k}").select("id", "words").collect()], shingle)
        index.prefixes(_rarity(now, index))
        now = _joined(now, index)
        if k + 1 < blocks:
            now = durable(now)
    now = durable(now.drop("text").withColumn("row", F.monotonically_increasing_id()))
    hit = now.where("size(windows) > 0")
    owned = hit.select("row", F.explode("windows").alias("id")).join(rows.join(each, "words").select("id", "item"), "id")
    listed = hit.join(owned.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")), "row")
    clean = now.where("size(windows) = 0").withColumn("items", F.expr("cast(array() as array<string>)"))
    both = clean.unionByName(listed)
    return both.select("doc_id", "n_words", "items", "spans", F.expr("aggregate(spans, 0L, (s, x) -> s + x.z - x.a)").alias("n_hit"))


def op5(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), dw as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
), hit as (
  select r, i, dw.n, item from dw join bw on dw.n = bw.n and dw.s = bw.s
), words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r
), listed as (
  select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct r, item from hit) group by r
)
select d.doc_id, coalesce(cast(len(d.w) as bigint), 0) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(listed.n_items, 0) as n_items,
  coalesce(listed.h, sha256('')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on d.r = words.r left join listed on d.r = listed.r
"""
