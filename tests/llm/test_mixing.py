import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from tidequery.llm import mixing


def draw(i, seed=mixing.SEED):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), h) if i is not None else h
    return (h >> 11) / 2**53


def test_rake_reaches_the_marginals():
    r = np.random.default_rng(3)
    cells = r.random(4 * 3 * 2) * 100 + 1
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    goals = [x / x.sum() for x in (r.random(4) + 0.2, r.random(3) + 0.2, r.random(2) + 0.2)]
    w = mixing.rake(cells, codes, goals)
    for c, g in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(c, weights=w), g, atol=1e-7)
    # the odds ratios of the start are kept
    a, b = cells.reshape(4, 3, 2), w.reshape(4, 3, 2)
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / x[0, 1, 0] / x[1, 0, 0]
    assert odds(a) == pytest.approx(odds(b))


def test_calibrated_keeps_the_budget():
    tokens, fitted = np.array([10.0, 20, 30, 1000]), np.array([0.5, 0.2, 0.2, 0.1])
    for rate in (0.001, 0.01, 0.05, 0.5, 1.0):
        p = mixing.calibrated(tokens, fitted, rate)
        assert p.max() <= 1 and (p * tokens).sum() == pytest.approx(rate * tokens.sum())
        free = p < 1
        assert np.ptp((p * tokens / fitted)[free]) < 1e-6 if free.sum() > 1 else True


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = [Row(doc_id=i, text=r.choice(["a | b ", "licence ", "12 34 ", "plain words "]) * r.randint(1, 400), lang=r.choice(["en", "en", "de", None]), source=r.choice(["s0"] * 6 + ["s1", "s2", None]), tokens=1, weight="x", p=None) for i in range(200)]
    rows += [Row(doc_id=None, text=None, lang="en", source="s0", tokens=1, weight="x", p=None), Row(doc_id=5, text="", lang="xx", source="s9", tokens=1, weight="x", p=None)] + rows[:4]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int, weight string, p double")


def test_both_fits_and_the_draw(docs):
    a = mixing.mixed(docs, rounds=4).collect()
    full = mixing.mixed(docs, rate=1.0)
    cells = {(r.source, r.lang, r._topic): r._p for r in a}
    tokens = {}
    for r in full.collect():
        k = (r.source, r.lang, r._topic)
        tokens[k] = tokens.get(k, 0) + r._tokens
        if r.doc_id is None:
            assert r._tokens == 1
    want = sorted((r.doc_id if r.doc_id is not None else -1) for r in full.collect() if draw(r.doc_id) < cells.get((r.source, r.lang, r._topic), 0))
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in a) == want
    b = {(r.source, r.lang, r._topic): r._p for r in mixing.mixed(docs, driver_cells=0, rounds=4).collect()}
    for k in cells.keys() & b.keys():
        assert cells[k] == pytest.approx(b[k], abs=1e-6)
    assert cells.keys() == b.keys()


def test_given_targets(docs):
    got = mixing.mixed(docs, targets={"lang": {"de": 1.0}}, rounds=3).collect()
    assert got and {r.lang for r in got} == {"de"} and all(r._p == 1 for r in got)
    table = mixing.mixed(docs, targets={"lang": {"de": 1.0}}, rounds=3, driver_cells=0).collect()
    assert sorted(r.doc_id for r in table) == sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.where("lang = 'de'").collect())
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0), driver_cells=-1).count() == 0


def test_names_that_clash_and_columns_of_its_own(docs):
    plain = mixing.mixed(docs)
    odd = docs.selectExpr("*", "1 as _topic", "2 as _tokens", "3 as _weight", "4 as _P", "5 as topic", "6 as __k_lang", "7 as k_source")
    got = mixing.mixed(odd)
    assert got.columns[:-4] == odd.columns and len({c.lower() for c in got.columns}) == len(got.columns)
    assert sorted(tuple(r) for r in got.select(*got.columns[-4:]).collect()) == sorted(tuple(r) for r in plain.select(*plain.columns[-4:]).collect())
    own = mixing.mixed(odd, topic="topic", tokens="tokens").collect()
    assert {r[-4] for r in own} == {5} and {r[-3] for r in own} == {1}


def test_calibrated_without_weight():
    t = np.array([10.0, 20, 30])
    assert mixing.calibrated(t, np.array([0.0, 1, 0]), 0.5).tolist() == [0, 1, 0]
    assert mixing.calibrated(t, np.zeros(3), 0.5).tolist() == [0, 0, 0]
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake(t, [np.array([0, 0, 1]), np.array([0, 0, 1])], [np.array([0.9, 0.1]), np.array([0.2, 0.8])], rounds=5)
