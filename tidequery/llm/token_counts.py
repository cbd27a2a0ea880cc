"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both agree for certain."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import mapped, slices, table

#: Characters whose class (letter, number, space, other) is the same in the Unicode versions of both regex engines.
SETTLED = r"\x00-\u0529\u2000-\u206f\u3000-\u30ff\u4e00-\u9fff"


def resolve(tokenizer: str) -> str:
    """The path of a tokenizer file: a path as it is, or the name of a public one as this machine has it."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer))


class Memo(dict):
    """Token counts by pre-token; emptied when it holds `most`, so its memory is bounded."""

    def __init__(self, count, most: int) -> None:
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.count(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the file's library does, without special tokens around the text.

    A byte-level BPE file (.json) is read left to right by pre-tokens, and what follows a pre-token's end doesn't depend
    on what precedes it. So a place where both of two overlapping chunks end a pre-token is a boundary of the whole text,
    if the earlier chunk goes on for `margin` characters (a special string and a look-ahead fit in there). Texts over
    `chunk` characters are encoded in chunks with an overlap; where an overlap has no such place, it is doubled, up to
    the text's end. Other tokenizer files have no such proof and encode whole texts.
    """

    def __init__(self, tokenizer: str, chunk: int = 1 << 16, overlap: int = 1 << 9, memo: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.chunk, self.overlap, self.widened = resolve(tokenizer), chunk, overlap, 0
        self.splices = False
        if self.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self.whole = lambda t: len(model.encode(t))
            return
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(self.path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole = lambda t: len(self.tok.encode(t, add_special_tokens=False))
        spec = json.loads(self.tok.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, self.tok.get_added_tokens_decoder().values()
        plain = all(not (a.lstrip or a.rstrip or a.single_word) for a in added)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and plain:
            import public_tokenizers
            import regex

            self.splices = True
            self.tok.post_processor = processors.ByteLevel(trim_offsets=False)
            self.pattern, self.memo = regex.compile(public_tokenizers.PATTERN), Memo(self.whole, memo)
            special = [a.content for a in added]
            self.rare = re.compile("|".join([f"[^{SETTLED}]", *map(re.escape, special)]))
            self.margin = 8 + max([0, *map(len, special)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splices:
            return self.whole(text)
        if len(text) > self.chunk:
            return self.spliced(text)
        if self.rare.search(text):
            return self.whole(text)
        return sum(map(self.memo.__getitem__, self.pattern.findall(text)))

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the pre-tokens of a chunk and the number of tokens up to each."""
        if not self.rare.search(text):
            found = self.pattern.findall(text)
            return np.cumsum([len(x) for x in found]), np.cumsum([self.memo[x] for x in found])
        e = self.tok.encode(text, add_special_tokens=False)
        words = e.word_ids
        last = [k for k in range(len(words)) if k + 1 == len(words) or words[k] is None or words[k] != words[k + 1]]
        return np.array([e.offsets[k][1] for k in last], np.int64), np.array(last, np.int64) + 1

    def spliced(self, text: str) -> int:
        n, total, at, start, stop, wide = len(text), 0, 0, 0, min(len(text), self.chunk), self.overlap
        ends, upto = self.pieces(text[start:stop])
        while stop < n:
            start2, stop2 = max(stop - wide, at), min(n, stop - wide + self.chunk)
            stop2 = max(stop2, min(n, stop + wide))
            ends2, upto2 = self.pieces(text[start2:stop2])
            common = np.intersect1d(ends + start, ends2 + start2)
            common = common[(common > at) & (common <= stop - self.margin)]
            if not len(common):
                self.widened += 1
                stop, wide = min(n, stop + wide), 2 * wide
                ends, upto = self.pieces(text[at:stop])
                start = at
                continue
            to = int(common[-1])
            before = upto[np.searchsorted(ends, at - start, side="right") - 1] if at > start else 0
            total += int(upto[np.searchsorted(ends, to - start)] - before)
            at, start, stop, ends, upto, wide = to, start2, stop2, ends2, upto2, self.overlap
        return total + int(upto[-1] - (upto[np.searchsorted(ends, at - start, side="right") - 1] if at > start else 0))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 9) -> DataFrame:
    """A row (doc_id, n_bytes, n_tokens, over_limit) for each row of docs, in one pass without a shuffle.

    n_bytes: length in UTF-8. over_limit: n_tokens > limit. A null or empty text has 0 of both. Special strings inside a
    text count as the library takes them by default. Repeated rows each give a row; null ids are kept; an empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer, chunk, overlap)
        for b in slices(batches):
            n = np.array([counter.count(t) for t in b.column("text").to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(few, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
