import hashlib
import random
import re
from collections import Counter

from tidequery.llm import weighted_sampling as ws


def bag(t):
    return Counter(w for w in re.split("[ \t\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_matches_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["É日", "🎉"]
    docs = [(i * 3, " ".join(r.choice(vocab) for _ in range(r.choice([1, 5, 80, 200])))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, docs[0][1]), (None, "null id"), (1004, "x" * 5000), (1005, "the " * 4000)]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in docs], "doc_id long, text string, k string, own int")
    got = {x.doc_id: x for x in ws.fingerprints(df).collect()}
    line = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    off, total = 0.0, 0
    for (i, t), (j, nxt) in zip(line, line[1:] + line[:1], strict=True):
        t, nxt, x = t or "", nxt or "", got[i]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(x.fingerprint) == len(x.edited_fingerprint) == 4 * ws.SAMPLES
        assert abs(x.near_edited - jaccard(t, e)) < 0.3 and abs(x.near_next - jaccard(t, nxt)) < 0.3
        assert x.near_next == sum(x.fingerprint[k : k + 4] == got[j].fingerprint[k : k + 4] for k in range(0, 4 * ws.SAMPLES, 4)) / ws.SAMPLES
        off += x.near_edited - jaccard(t, e) + x.near_next - jaccard(t, nxt)
        total += 2
    assert abs(off / total) < 0.02
    assert got[0].fingerprint == got[1003].fingerprint
    assert got[1000].fingerprint == got[1001].fingerprint == got[1002].fingerprint == "ffff" * ws.SAMPLES


def test_repeats_and_small_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ws.fingerprints(df).collect()
    assert sorted(x.doc_id for x in out) == [1, 1, 1, 2]
    assert {x.edited_sha256 for x in out if x.doc_id == 1} == {hashlib.sha256(x.encode()).hexdigest() for x in ("a b c i", "e f g i")}
    one = ws.fingerprints(df.where("doc_id = 2")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"i j k i").hexdigest()
    assert ws.fingerprints(df.limit(0)).count() == 0
