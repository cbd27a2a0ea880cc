import random
import re

from pyspark.sql import Row

from tidequery.llm import decontam as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = [(str(i), ws[k : k + min(10, len(ws))]) for i, t in items if i is not None and (ws := words(t)) for k in range(max(1, len(ws) - 9))]
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for i, w in wins:
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(i)
        out.append((d, len(ws), sorted(found), len(hit)))
    return sorted(out, key=str)


def cases(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "a", "Été", "x1", "Q", "zebra", "日本", "non", "B2b"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for i in range(25)] + [(3, "same id"), (99, None), (None, "zebra"), (100, "solo"), (101, "solo")]
    docs = []
    for i in range(80):
        w = [word() for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            t = r.choice(items)[1] or ""
            w[3:3] = re.split(r"\s", t.upper() if t.isascii() else t)
        docs.append((i, r.choice([" ", "\n", "--"]).join(w)))
    return docs + [(7, None), (8, ""), (None, "solo"), (9, "...\x00\x7f"), (10, "the " * 5000)], items


def test_matches_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([Row(doc_id=a, text=b, items=1) for a, b in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK, 60):
        got = dc.contamination(d, b, block=block).collect()
        assert sorted([(r.doc_id, r.n_words, r["items"], r.n_hit) for r in got], key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dc.contamination(d.limit(0), b).count() == 0
    assert dc.contamination(d, b.limit(0)).first().n_hit == 0


def test_a_window_that_all_items_have(spark):
    frame = "read the text below and choose the one right answer"
    items = [(f"i{k:04d}", f"{frame} q{k} is it") for k in range(3000)]
    docs = [(1, f"so {frame} now"), (2, f"{frame} q7 is it"), (2, "nothing"), (3, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r.doc_id, r["items"], r.n_hit) for r in dc.contamination(d, b, block=2000).collect())
    every = [i for i, _ in items]
    assert got == [(1, every, 10), (2, [], 0), (2, every, 13), (3, [], 0)]
