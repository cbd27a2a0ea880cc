import math
import random
from zlib import crc32

import numpy as np
from pyspark.sql import Row

from tidequery.llm import langid

SOUNDS = {"de": ["sch", "ung", "ein", "ü", "und "], "en": ["th", "ing", "ou", "wh", "the "], "fr": ["eau", "é", "que", "ç", "les "]}


def corpus(n=240, seed=2):
    r = random.Random(seed)
    return [(lang, " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60)))) for lang in (r.choice(sorted(SOUNDS)) for _ in range(n))]


def brute_buckets(t, bits=langid.BITS):
    t, out = t.lower(), []
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h * 0x9E3779B1 + ord(c)) % 2**32
            out.append(((h + n) * 0x85EBCA6B % 2**32) >> (32 - bits))
    return sorted(out)


def test_buckets_and_sums(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 50)
    ts = ["", "a", "Äb", "abcdefg" * 40, "x" * 49, "x" * 50, "x" * 51, None, "hello wörld"]
    m = np.random.default_rng(0).random(((1 << langid.BITS) + 1, 3)).astype(np.float32)
    m[-1] = 0
    got = langid.sums(ts, m)
    for t, s in zip(ts, got, strict=True):
        want = m[brute_buckets(t or "")].sum(axis=0, dtype=np.float64) if t else np.zeros(3)
        assert np.allclose(s, want)
    assert sorted(np.concatenate(list(langid.buckets(ts[3]))).tolist()) == brute_buckets(ts[3])


def test_accuracy_on_held_out_texts(spark):
    rows = [Row(doc_id=i, text=t, lang=g) for i, (g, t) in enumerate(corpus())]
    odd = [Row(doc_id=1000, text=None, lang="en"), Row(doc_id=1001, text="", lang=None), Row(doc_id=1002, text="12 ²!", lang="fr"), Row(doc_id=None, text="the thing", lang="zz")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.learned(df)
    assert model.langs == ["de", "en", "fr"]
    said = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([said[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (1000, 1001, 1002))
    assert said[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in said.values())
    assert {r.doc_id for r in df.where(langid.HELD_OUT).collect()} == {r.doc_id for r in rows + odd[:3] if crc32(str(r.doc_id).encode()) % 4 == 2}


def brute(train, texts, alpha=0.5):
    """(language, posterior, gain) by a naive Bayes over dictionaries."""
    counts, docs = {}, {}
    for g, t in train:
        own = counts.setdefault(g, {})
        docs[g] = docs.get(g, 0) + 1
        for x in brute_buckets(t):
            own[x] = own.get(x, 0) + 1
    out = []
    for t in texts:
        found = brute_buckets(t)
        size = {g: sum(own.values()) + alpha * 2**langid.BITS for g, own in counts.items()}
        plain = {g: sum(math.log((own.get(x, 0) + alpha) / size[g]) for x in found) for g, own in counts.items()}
        s = {g: v + math.log(docs[g] / sum(docs.values())) for g, v in plain.items()}
        best = min(s, key=lambda g: (-s[g], g))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values()), plain[best] / len(found) + langid.BITS * math.log(2)))
    return out


def test_matches_brute_force_in_one_part_and_in_several(spark):
    train = corpus(60)
    texts = [t for _, t in corpus(40, 7)] + ["x", "zzqx kkvw", "ein the", "eau " * 20_000, "привет мир " * 9]
    want = brute(train, texts)
    labelled = spark.createDataFrame(train, "lang string, text string")
    docs = spark.createDataFrame([(k, t, 1.0, "z") for k, t in enumerate(texts)], "doc_id long, text string, best double, gain string")
    for block in (langid.LANGS, 1):
        model = langid.fit(labelled, block=block)
        got = sorted(langid.predict(docs, model).collect())
        for r, (g, p, gain) in zip(got, want, strict=True):
            assert r.lang_pred == g and abs(r.score - p) < 1e-3 and abs(r.gain - gain) < 1e-3
        assert got[-1].gain < 0 < got[0].gain


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([("b", "same text"), ("a", "same text")], "lang string, text string")
    for block in (langid.LANGS, 1):
        r = langid.predict(df.selectExpr("1 as doc_id", "text"), langid.fit(df, block=block)).first()
        assert r.lang_pred == "a" and abs(r.score - 0.5) < 1e-6


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learned(df)
    assert model.langs == [] and langid.predict(df, model).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.predict(one, model).first().lang_pred == "und"
