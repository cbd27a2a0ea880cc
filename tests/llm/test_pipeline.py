import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.test_decontam import words as item_words
from tests.llm.test_simhash import brute_components, brute_fp

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=11):
    r = random.Random(seed)
    sounds = {"en": ["th", "ing", "wh", "er", "an"], "de": ["sch", "ung", "ü", "ei", "pf"]}
    word = lambda g: "".join(r.choice(sounds[g]) for _ in range(r.randint(1, 4)))
    docs = []
    for i in range(160):
        g = r.choice(["en", "en", "de"])
        text = "\n".join(" ".join(word(g) for _ in range(r.randint(8, 30))) for _ in range(r.randint(1, 5)))
        if i % 4 == 0:
            text = "Home | Next page\n" + text
        docs.append([i, text, g if i % 9 else None, r.choice(["a", "a", "b", None])])
    items = [(1, " ".join(word("en") for _ in range(14))), (2, " ".join(word("en") for _ in range(5)))]
    docs[20][1] += "\n" + items[0][1].upper()
    docs[21][1] = "xx " + items[1][1] + " yy"
    docs += [[200, docs[3][1], "en", "a"], [201, docs[5][1] + " end", "en", "b"], [202, None, "en", "a"], [203, "", None, None], [204, "123 ... 456", "en", "b"], [205, "привет мир как дела " * 9, None, "a"], [7, docs[7][1], docs[7][2], docs[7][3]]]
    return [(*d, len(d[1] or "")) for d in docs], items


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, items = corpus()
    spark.createDataFrame(docs, COLS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_stages_match_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(cp, "GAIN", -0.5)  # a model of so few texts is never as sure
    d, docs, items = data
    now = spark.read.parquet(f"{d}/documents.parquet")
    s1 = [tuple(x) for x in cp.language(spark, now, d).collect()]
    assert {x[0] for x in docs} - {x[0] for x in s1} == {202, 203, 204, 205}
    s2 = sorted(tuple(x) for x in cp.lines(spark, spark.createDataFrame(s1, COLS), d).collect())
    pages = Counter(x[3] for x in s1 if x[3])
    often = Counter((x[3], y) for x in s1 if x[3] for y in {z.strip(" ") for z in x[1].split("\n")})
    want = []
    for x in s1:
        kept = [y for y in x[1].split("\n") if not (x[3] and often[x[3], y.strip(" ")] >= 3 and often[x[3], y.strip(" ")] > 0.1 * pages[x[3]])]
        t = "\n".join(kept)
        want.append((x[0], t, x[2], x[3], len(t)))
    assert s2 == sorted(want) and s2 != sorted(s1)
    s3 = sorted(tuple(x) for x in cp.near_duplicates(spark, spark.createDataFrame(s2, COLS), d).collect())
    comp = brute_components([x[0] for x in s2], [brute_fp(x[1]) for x in s2])
    assert s3 == sorted({x for x, c in zip(s2, comp, strict=True) if x[0] == c}) and len(s3) < len(s2)
    s4 = sorted(tuple(x) for x in cp.benchmark(spark, spark.createDataFrame(s3, COLS), d).collect())
    joined = {i: f" {' '.join(item_words(t))} " for i, t in items}
    wins = [" ".join(w[k : k + 10]) for t in joined.values() for w in [t.split()] for k in range(max(1, len(w) - 9))]
    assert s4 == [x for x in s3 if not any(f" {w} " in f" {' '.join(item_words(x[1]))} " for w in wins)] and len(s4) < len(s3)
    s5 = cp.mix(spark, spark.createDataFrame(s4, COLS), d)
    assert s5.columns[:5] == cp.COLUMNS and 0 < s5.count() < len(s4)
    assert sorted(tuple(x)[:5] for x in cp.run(spark, d).collect()) == sorted(tuple(x)[:5] for x in s5.collect())


def test_rows_that_share_an_id_are_judged_by_themselves(spark, data):
    d, docs, items = data
    good = [x for x in docs if x[0] in (3, 8)]
    rows = [*good, (8, None, "en", "a", 0), (8, items[0][1], "en", "a", 70), (None, good[0][1] + " x", None, None, 5), (None, "wher thing ing ther" * 2000, "en", "b", 6)]
    now = spark.createDataFrame(rows, COLS)
    full = spark.createDataFrame([*rows, *docs], COLS)
    assert sorted(x.doc_id or -1 for x in cp.language(spark, full, d).where("doc_id is null or doc_id in (3, 8)").collect()) == [-1, -1, 3, 3, 8, 8, 8]
    near = [(x.doc_id, x.text) for x in cp.near_duplicates(spark, now, d).collect()]
    assert (3, good[0][1]) in near and (None, good[0][1] + " x") not in near and len([x for x in near if x[0] == 8]) == 3
    clean = [(x.doc_id, x.text) for x in cp.benchmark(spark, now, d).collect()]
    assert (8, items[0][1]) not in clean and (8, None) in clean and len(clean) == len(rows) - 1


def test_empty_documents(spark, data):
    now = spark.createDataFrame([], COLS)
    for _, stage in cp.STAGES:
        now = stage(spark, now, data[0])
        assert now.count() == 0
