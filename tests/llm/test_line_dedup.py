import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidequery.llm import line_dedup as ld


def test_host_and_lines(spark):
    html = "<html><head><title>T &amp; x</title><script>var a='</p>';</script></head><body><p>one <b>bold</b> word<br>two<!-- no\n--></p><style>p{}</style>\n three </body>"
    df = spark.createDataFrame([("HTTPS://u:p@Www.Ex.com:80/a?b", html), (None, None), ("no url", ""), ("http://h.org", "<p></p>")], "url string, html string")
    got = df.select(ld.host_of("url").alias("h"), ld.html_lines("html").alias("l")).collect()
    assert [tuple(r) for r in got] == [("www.ex.com", ["T &amp; x", "one bold word", "two", "three"]), (None, []), (None, []), ("h.org", [])]


def brute(rows, ratio, least):
    pages = Counter(h for h, _ in rows if h is not None)
    often = Counter((h, x) for h, ls in rows if h is not None and ls for x in {y.strip(" ") for y in ls} if x)
    bad = {k for k, n in often.items() if n >= least and n > ratio * pages[k[0]]}
    return [(h, None if ls is None else [x for x in ls if (h, x.strip(" ")) not in bad]) for h, ls in rows]


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), [r.choice(["x", " x", "y", "", "z"]) if r.random() < 0.3 else f"l{r.randint(0, 60)}" for _ in range(r.randint(0, 8))]) for _ in range(300)]
    rows += [("d", ["only"]), ("a", None), ("b", []), ("a", ["w" * 100_000])]
    df = spark.createDataFrame([Row(host=h, lines=x, kept=1, n=2, d=3) for h, x in rows], "host string, lines array<string>, kept int, n int, d int")
    want = sorted(brute(rows, 0.08, 10), key=repr)
    for most in (ld.BROADCAST, 0):
        out = ld.drop_boilerplate(df, "host", "lines", "left_over", 0.08, 10, broadcast=most, salts=4)
        assert out.columns == [*df.columns, "left_over"]
        assert sorted([(x.host, x.left_over) for x in out.collect()], key=repr) == want
        again = ld.drop_boilerplate(df, "host", "lines", "KEPT", 0.08, 10, broadcast=most, salts=4)
        assert again.columns == ["host", "lines", "n", "d", "KEPT"] and sorted([(x.host, x.KEPT) for x in again.collect()], key=repr) == want
    assert any(a != b for a, b in zip(sorted(rows, key=repr), want, strict=True))
    assert ld.drop_boilerplate(df.limit(0), "host", "lines").count() == 0


def test_repeated_line_counts_once_a_page(spark):
    df = spark.range(20).select(F.lit("h").alias("host"), F.when(F.col("id") == 0, F.array_repeat(F.lit("s"), 9)).otherwise(F.array(F.col("id").cast("string"))).alias("lines"))
    assert all(r.kept == r.lines for r in ld.drop_boilerplate(df, "host", "lines").collect())


def test_small_hosts_are_judged(spark):
    rows = [("s", ["foot", f"l{i}"]) for i in range(4)] + [("t", ["foot", "x"]), ("t", ["foot", "y"])]
    got = ld.drop_boilerplate(spark.createDataFrame(rows, "host string, lines array<string>"), "host", "lines").collect()
    assert sorted((r.host, r.kept) for r in got) == sorted([("s", [f"l{i}"]) for i in range(4)] + rows[4:])
