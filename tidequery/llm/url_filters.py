"""URL filters: dated list entries become validity intervals; captures are judged by the entries active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidequery.llm.common import durable, table
from tidequery.llm.line_dedup import host_of

#: Rows of list intervals that are broadcast; more are joined by key and period.
BROADCAST = 50_000
#: Seconds of a period. An interval has a row for each period with captures that it touches, so both sides meet on equal
#: keys. With more periods than PERIODS that have captures, periods are longer.
PERIOD, PERIODS = 32 * 86400, 4096
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, start, stop) in seconds from entries (list, pattern, action, at: timestamp).

    Entries of a pattern follow each other in time; each `add` is active until the next entry, the last one for good (stop
    null). Of entries at the same time only one counts: an add before a remove. Other actions than add and remove and
    entries with a null pattern or time are left out. Repeated entries change nothing.
    """
    rows = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    rows = rows.groupBy("list", F.lower("pattern").alias("pattern"), F.unix_timestamp("at").alias("start")).agg(F.min("action").alias("action"))
    rows = rows.withColumn("stop", F.lead("start").over(Window.partitionBy("list", "pattern").orderBy("start")))
    return rows.where("action = 'add'").select("list", "pattern", "start", "stop")


def patterns_of(url: Column) -> Column:
    """The patterns that apply to a URL: its host and each parent domain, each alone and with the first part of the path."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    first = F.regexp_extract(F.lower(url), _PATH, 1)
    both = F.when(first == "", hosts).otherwise(F.concat(hosts, F.transform(hosts, lambda h: F.concat(h, F.lit("/"), first))))
    return F.when(host_of(url).isNull(), F.expr("cast(array() as array<string>)")).otherwise(both)


def _periods(captures: DataFrame, at_col: str, period: int) -> tuple[int, list[int]]:
    """(seconds of a period, the periods in which there are captures): PERIODS at most, as a century has 1141 of 32 days; for more, periods are four times as long."""
    seconds = captures.select(F.unix_timestamp(at_col).alias("at")).where("at is not null")
    while True:
        found = seconds.select(F.floor(F.col("at") / period).alias("p")).distinct().limit(PERIODS + 1).collect()
        if len(found) <= PERIODS:
            return period, sorted(r.p for r in found)
        period *= 4


def judged(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str, broadcast: int = BROADCAST, period: int = PERIOD) -> DataFrame:
    """A row (id, url, at, blocked, n_entries, first_pattern, lists) for each capture.

    n_entries: entries active at the fetch time that apply to the URL; first_pattern: the least of their patterns; lists:
    their lists, sorted. A capture with a null URL, no host or a null time matches nothing. Repeated captures are judged
    once and each give a row. Dates may be as far off as a timestamp holds: an interval has rows for the periods with
    captures only. Empty tables are fine; other columns are ignored.
    """
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.unix_timestamp(at_col).alias("at")).groupBy("id", "url", "at").agg(F.count("*").cast("int").alias("copies"))
    period, periods = _periods(captures, at_col, period)
    keyed = base.select("*", F.explode_outer(patterns_of(F.col("url"))).alias("pattern"), F.floor(F.col("at") / period).alias("p"))
    known = F.lit(",".join(map(str, periods)))
    spans = intervals(entries).withColumn("_a", F.floor(F.col("start") / period)).withColumn("_z", F.floor((F.col("stop") - 1) / period))
    spans = spans.withColumn("p", F.explode(F.filter(F.split(known, ",").cast("array<long>") if periods else F.expr("cast(array() as array<long>)"), lambda p: (p >= F.col("_a")) & (F.col("_z").isNull() | (p <= F.col("_z"))))))
    spans = durable(spans.select("list", F.col("pattern").alias("entry"), "start", "stop", F.col("p").alias("ep")))
    if spans.count() <= broadcast:
        spans = F.broadcast(spans)
    on = (F.col("pattern") == F.col("entry")) & (F.col("p") == F.col("ep")) & (F.col("start") <= F.col("at")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    met = keyed.join(spans, on, "left").groupBy("id", "url", "at", "copies").agg(F.count("entry").alias("n_entries"), F.min("entry").alias("first_pattern"), F.array_sort(F.collect_set("list")).alias("lists"))
    return met.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "url", F.timestamp_seconds("at").alias("at"), (F.col("n_entries") > 0).alias("blocked"), "n_entries", "first_pattern", "lists")


def _number(of: str) -> str:
    return f"cast(conv(substr(md5({of}), 1, 7), 16, 10) as bigint)"


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages by rule, as the tables have none: a third of the hosts is added within a year, half of these are removed later, and some first path parts are added and removed twice."""
    hosts = pages.select(host_of("url").alias("h")).where("h is not null").distinct().withColumn("k", F.expr(_number("h")))
    day = lambda e: F.expr(f"timestamp_seconds(1704067200 + ({e}) * 86400)")
    row = lambda where, name, pattern, action, at: hosts.where(where).select(F.lit(name).alias("list"), F.expr(pattern).alias("pattern"), F.lit(action).alias("action"), day(at).alias("at"))
    out = row("k % 3 = 0", "hosts", "h", "add", "k % 365")
    for x in (
        row("k % 6 = 0", "hosts", "h", "remove", "k % 365 + k % 90"),
        row("k % 4 = 1", "paths", "h || '/de'", "add", "k % 100"),
        row("k % 4 = 1", "paths", "h || '/de'", "remove", "k % 100 + 50"),
        row("k % 8 = 1", "paths", "h || '/de'", "add", "k % 100 + 150"),
    ):
        out = out.unionByName(x)
    return out


def op3(spark, sf_dir: str) -> DataFrame:
    """Each page judged by that list, as if fetched at a time that its URL gives."""
    pages = table(spark, sf_dir, "pages")
    fetched = pages.select("page_id", "url", F.expr(f"timestamp_seconds(1704067200 + {_number('url')} % 31536000)").alias("fetched"))
    out = judged(fetched, sample_entries(pages), "page_id", "url", "fetched")
    return out.select(F.col("id").alias("page_id"), "url", F.unix_timestamp("at").alias("fetched"), "blocked", "n_entries", "first_pattern", F.array_join("lists", ",").alias("lists"))


_HOSTS = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')"
OP3_SQL = rf"""
with h as (
  select h, cast(('0x' || substr(md5(h), 1, 7)) as bigint) as k from (select distinct {_HOSTS} as h from pages) where h is not null
), e as (
  select 'hosts' as list, h as pattern, 'add' as action, k % 365 as d from h where k % 3 = 0
  union all select 'hosts', h, 'remove', k % 365 + k % 90 from h where k % 6 = 0
  union all select 'paths', h || '/de', 'add', k % 100 from h where k % 4 = 1
  union all select 'paths', h || '/de', 'remove', k % 100 + 50 from h where k % 4 = 1
  union all select 'paths', h || '/de', 'add', k % 100 + 150 from h where k % 8 = 1
), s as (
  select list, pattern, 1704067200 + d * 86400 as t, min(action) as action from e group by list, pattern, d
), c as (
  select row_number() over () as r, page_id, url, 1704067200 + cast(('0x' || substr(md5(url), 1, 7)) as bigint) % 31536000 as tm, {_HOSTS} as host,
    regexp_extract(lower(url), '{_PATH}', 1) as seg from pages
), l as (
  select r, tm, seg, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) as d from c where host is not null
), q as (
  select r, tm, d as pattern from l union all select r, tm, d || '/' || seg from l where seg <> ''
), a as (
  select r, s.list, s.pattern, s.action, row_number() over (partition by r, s.list, s.pattern order by s.t desc) as w
  from q join s on q.pattern = s.pattern and s.t <= q.tm
), m as (
  select r, count(*) as n_entries, min(pattern) as first_pattern, string_agg(distinct list, ',' order by list) as lists from a where w = 1 and action = 'add' group by r
)
select page_id, url, tm as fetched, m.r is not null as blocked, coalesce(n_entries, 0) as n_entries, first_pattern, coalesce(lists, '') as lists
from c left join m on c.r = m.r
"""
