import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidequery.llm import token_counts as tc

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(str(public_tokenizers.path(NAME)))
    return lambda s: len(t.encode(s, add_special_tokens=False)) if s else 0


def odd_texts():
    r = random.Random(3)
    bits = ["hello ", "wor\nld  ", "\t\t ", "don't 'll", "éàü ", "日本語", "🎉", "<|endoftext|>", "<|endof", "text|>", "123 456", "!!?? ", " ", "   ", "\r\n", "ٱلْعَرَبِيَّة", "՘", "a" * 50, "\x1c\x85\xa0"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", " ", "<|endoftext|>", "x" * 3000, " " * 3000, "\n" * 999 + "a"]


def test_settled_characters_split_alike(plain):
    counter = tc.TokenCounter(NAME)
    pre = counter.tok.pre_tokenizer
    inside = regex.compile(f"[{tc.SETTLED}]")
    for lo in range(0, 0xA000, 512):
        s = "".join(f"a{c}1{c}.{c} {c}b " for c in map(chr, range(lo, lo + 512)) if inside.match(c))
        assert [p for _, p in pre.pre_tokenize_str(s)] == [m.span() for m in counter.pattern.finditer(s)]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 512), (64, 24), (40, 1), (200, 60)])
def test_counts_equal_the_library(plain, chunk, overlap):
    counter = tc.TokenCounter(NAME, chunk, overlap)
    for t in odd_texts():
        assert counter.count(t) == plain(t), repr(t[:80])


def test_overlap_is_widened(plain):
    counter = tc.TokenCounter(NAME, 64, 20)
    t = "word " * 30 + "x" * 900 + " end of it" * 20
    assert counter.count(t) == plain(t) and counter.widened


def test_table(spark, plain):
    ts = [*odd_texts(), None]
    df = spark.createDataFrame([Row(doc_id=i, text=t, n_tokens="x") for i, t in enumerate(ts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tc.token_counts(df, NAME, limit=100).collect()}
    for i, t in enumerate(ts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (plain(t), len((t or "").encode()), plain(t) > 100)
    assert tc.token_counts(df.limit(0), NAME).count() == 0


def test_other_libraries_encode_whole_texts():
    assert tc.TokenCounter("piece_bpe_32k.model").count("hello there world") > 0
    assert tc.TokenCounter("word_bpe_49k.json").count("hello there world") == 3
