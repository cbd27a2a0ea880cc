import random

import numpy as np
import xxhash
from pyspark.sql import Row

from tidequery.llm import simhash


def brute_fp(t):
    w = [x for x in (t or "").encode().lower().split()]
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def corpus(n=300, seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(1, 120))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "zz"
        out.append("\n ".join(w))
    return [*out, None, "", " \t\n", "Ünï CÖDE Words here and there", "x", "x y z", "same", "same"]


def test_kernels_match_brute_force():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    x = base[r.integers(0, 20, 500)] ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64))
    y = base[r.integers(0, 20, 500)] ^ (np.uint64(7) << r.integers(0, 60, 500, dtype=np.uint64))
    for radius in range(8):
        want = np.bitwise_count(x ^ y) <= radius
        assert (simhash.close_pairs(x, y, radius) == want).all()
    lab = simhash.linked(x, None, 4)
    ids = list(range(len(x)))
    assert lab.tolist() == brute_components(ids, [int(v) for v in x])
    both = simhash.linked(x[:200], x[200:], 4)
    adj = np.bitwise_count(x[:200, None] ^ x[None, 200:]) <= 4
    for i, j in zip(*np.nonzero(adj), strict=True):
        assert both[i] == both[200 + j]


def test_fingerprint_in_pieces():
    t = " ".join(f"w{i % 977}" for i in range(300000)).encode()
    assert len(t) > 1 << 20
    assert simhash.fingerprint(t) == brute_fp(t.decode())


def test_near_duplicates_match_brute_force(spark):
    ts = corpus()
    ids = [*range(len(ts) - 2), 7, None]
    rows = [Row(doc_id=i, text=t, fp="clash", component_id=3.0) for i, t in zip(ids, ts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")
    for block in (simhash.BLOCK, 5):
        got = sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, block=block).collect()], key=str)
        fps = [brute_fp(t) for t in ts]
        assert got == sorted(zip(ids, fps, brute_components(ids, fps), strict=True), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
