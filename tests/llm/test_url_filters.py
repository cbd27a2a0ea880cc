import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from tidequery.llm import url_filters as uf

T0 = datetime(2024, 1, 1)


def patterns(url):
    if not url or "://" not in url:
        return set()
    host, _, path = url.split("://", 1)[1].lower().partition("/")
    if not host:
        return set()
    parts, seg = host.split("."), path.split("/")[0].split("?")[0].split("#")[0]
    hosts = {".".join(parts[k:]) for k in range(len(parts))}
    return hosts | ({f"{h}/{seg}" for h in hosts} if seg else set())


def brute(caps, entries):
    out = []
    for i, u, t in caps:
        act = []
        for lst, p in {(e[0], e[1].lower()) for e in entries if e[1] is not None}:
            past = [(e[3], e[2] == "add") for e in entries if e[0] == lst and e[1] is not None and e[1].lower() == p and e[3] is not None and t is not None and e[3] <= t and e[2] in ("add", "remove")]
            if past and max(past)[1] and p in patterns(u):
                act.append((lst, p))
        out.append((i, u, bool(act), len(act), min((p for _, p in act), default=None), sorted({x for x, _ in act})))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.com", "b.a.com", "C.b.a.com", "com", "d.org"]
    day = lambda: T0 + timedelta(days=r.randint(0, 200))
    entries = [(r.choice(["l1", "l2"]), r.choice([*hosts, "a.com/x", "d.org/Y"]), r.choice(["add", "add", "remove", "note"]), day()) for _ in range(60)]
    entries += entries[:5] + [("l1", None, "add", T0), ("l1", "a.com", "add", None), ("l3", "a.com/x", "add", datetime(1700, 1, 1)), ("l3", "d.org/y", "add", datetime(1750, 1, 1)), ("l3", "d.org/y", "remove", datetime(1900, 1, 1))]
    caps = [(i % 70, f"http://{r.choice(hosts)}/{r.choice(['x', 'y/z', '', 'X?q'])}", day()) for i in range(120)]
    caps += caps[:3] + [(900, None, T0), (901, "no url", T0), (902, "http://a.com/", None), (None, "http://a.com/x", day()), (903, "http://a.com/x", datetime(9000, 1, 1)), (904, "http://d.org/Y", datetime(1800, 5, 5))]
    c = spark.createDataFrame([Row(page_id=a, url=b, ts=t and t.replace(tzinfo=timezone.utc), list="z", pattern=1) for a, b, t in caps], "page_id long, url string, ts timestamp, list string, pattern int")
    e = spark.createDataFrame([Row(list=a, pattern=b, action=x, at=t and t.replace(tzinfo=timezone.utc)) for a, b, x, t in entries], "list string, pattern string, action string, at timestamp")
    for most in (uf.BROADCAST, 0):
        got = uf.judged(c, e, "page_id", "url", "ts", broadcast=most, period=20 * 86400).collect()
        assert sorted([(x.id, x.url, x.blocked, x.n_entries, x.first_pattern, x.lists) for x in got], key=repr) == brute(caps, entries)
    assert uf.judged(c.limit(0), e, "page_id", "url", "ts").count() == 0
    assert not any(x.blocked for x in uf.judged(c, e.limit(0), "page_id", "url", "ts").collect())
