"""Line dedup by site-relative frequency: lines that too large a share of a host's pages contain are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import durable, table

#: A line is boilerplate if over this share of its host's pages contain it, and MIN_COPIES pages at least.
RATIO, MIN_COPIES = 0.1, 3
#: Line digests that are broadcast (16 bytes each and some); more are joined by host and a salt.
BROADCAST, SALTS = 200_000, 64

#: Fixed patterns of the conversion of HTML to lines.
_HIDDEN = r"(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:html|head|body|title|nav|header|footer|main|article|section|aside|div|p|br|hr|ul|ol|li|table|tr|td|th|h[1-6]|pre|blockquote|form)(?:[\s/][^>]*)?>"
_TAG = r"<[^>]*>"
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | Column) -> Column:
    """The lower-cased host of a URL; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(""))


def html_lines(html: str | Column) -> Column:
    """The lines of a page as text: split at block tags, other tags and what isn't shown removed, trimmed, none empty. Null gives an empty list."""
    html = F.col(html) if isinstance(html, str) else html
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BLOCK, "\n"), _TAG, "")
    return F.coalesce(F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.expr("cast(array() as array<string>)"))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, min_copies: int = MIN_COPIES) -> DataFrame:
    """(host, digests): the MD5 of each boilerplate line of a host.

    A line counts once a page. The shuffle is by host and line, after adding up in each task; what is left to a host are
    fewer digests than its mean of lines a page divided by the ratio.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(lines).alias("lines")).where("host is not null")
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    often = each.groupBy("host", _digest(F.col("line")).alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= min_copies)
    found = often.join(total, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("d").alias("digests"))


def drop_boilerplate(pages: DataFrame, host: str, lines: str, kept: str = "kept", ratio: float = RATIO, min_copies: int = MIN_COPIES, broadcast: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """pages and a column `kept`: its lines without the boilerplate of its host, in order.

    Lines are the same if they are equal after trimming; blank lines always stay. A page without a host (null) keeps all
    lines; a null list stays null. A column of pages that is named like `kept` is replaced. Repeated rows count as pages of
    their own; an empty table gives an empty result. The digests are broadcast if there are at most `broadcast`;
    otherwise pages join them by host and one of `salts` salts, so a host with a third of all pages is spread.
    """
    names = pages.columns
    found = durable(boilerplate(pages, host, lines, ratio, min_copies))
    total = found.agg(F.sum(F.size("digests"))).first()[0] or 0
    taken = "_" + max(names, key=len)
    found = found.select(F.col("host").alias(f"{taken}_h"), F.col("digests").alias(f"{taken}_d"))
    on = F.col(host) == F.col(f"{taken}_h")
    if total <= broadcast:
        joined = pages.join(F.broadcast(found), on, "left")
    else:
        found = found.withColumn(f"{taken}_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = F.pmod(F.xxhash64(F.col(lines)), F.lit(salts)).cast("int")
        joined = pages.withColumn(f"{taken}_p", spread).join(found, on & (F.col(f"{taken}_p") == F.col(f"{taken}_s")), "left")
    keep = F.when(F.col(f"{taken}_d").isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(f"{taken}_d"), _digest(x))))
    return joined.select(*(F.col(f"`{n}`") for n in names if n.lower() != kept.lower()), keep.alias(kept))


def op2(spark, sf_dir: str) -> DataFrame:
    """Each page with its host, its lines, how many went as boilerplate of its host, and a digest of what is left."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of("url").alias("host"), html_lines("html").alias("lines"))
    out = drop_boilerplate(pages, "host", "lines")
    left = F.array_join("kept", "\n")
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.length(left).cast("long").alias("kept_chars"), F.md5(left.cast("binary")).alias("kept_md5"))


OP2_SQL = rf"""
with p as (
  select row_number() over () as r, page_id, nullif(regexp_extract(lower(url), '{_HOST}', 1), '') as host,
    coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), []) as lines
  from pages
), t as (
  select host, count(*) as n from p where host is not null group by host
), f as (
  select host, line, count(*) as n from (select distinct r, host, unnest(lines) as line from p where host is not null) group by host, line
), b as (
  select f.host, list(line) as bad from f join t on f.host = t.host where f.n >= {MIN_COPIES} and f.n > {RATIO} * t.n group by f.host
), k as (
  select p.*, case when bad is null then lines else list_filter(lines, lambda x: not list_contains(bad, x)) end as kept from p left join b on p.host = b.host
)
select page_id, host, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(kept) as bigint) as n_dropped,
  cast(length(coalesce(array_to_string(kept, chr(10)), '')) as bigint) as kept_chars, md5(coalesce(array_to_string(kept, chr(10)), '')) as kept_md5
from k
"""
