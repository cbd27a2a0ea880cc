"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For each term of weight w and each of `samples` draws, r and c are Gamma(2, 1) and b is uniform, all fixed by the term and
the draw; t = floor(ln w / r + b), and the draw keeps the least ln c - r (t + 1 - b) of all terms. Two weighted sets keep
the same value with a probability that equals their generalised Jaccard similarity, sum of min(w) over sum of max(w).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidequery.llm.common import durable, table

SAMPLES, WIDE = 64, 2
#: A null id stands before all others; its key is the least long, which is no id of its own.
_KEY, _ID = "coalesce(doc_id, -9223372036854775808L)", "nullif(k, -9223372036854775808L)"


def words(text: str | Column) -> Column:
    """The terms of a text: its words between white space, with A-Z in lower case."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", "abcdefghijklmnopqrstuvwxyz     "), " ")


def _gamma(key: str, n: str, z: str) -> tuple[str, str, str]:
    """Gamma(2, 1) from 64 random bits in three steps: (bits to n, bits to x, n and z to the value) with z = (x - 1/2) / (x + 1/2).

    It is the sum of two exponentials, each ln 2 times a geometric number and a part below ln 2. The numbers add up to the
    place of the second set bit (24 bits); the parts to -ln x with x = (1 - u/2)(1 - v/2) (20 bits each), which the series
    of atanh gives to 1e-7. There is no logarithm, which isn't compiled in place.
    """
    f, q = f"shiftrightunsigned({key}, 40)", f"{z} * {z}"
    y = f"(({f} & ({f} - 1L)) | 16777216L)"
    series = "0.09090909090909091D"
    for k in (9, 7, 5, 3, 1):
        series = f"({1 / k!r}D + {q} * {series})"
    return f"bit_count({y} ^ ({y} - 1L))", f"(2097152L - (shiftrightunsigned({key}, 20) & 1048575L)) * (2097152L - ({key} & 1048575L)) * {2.0**-42!r}D", f"({n} - 1) * {log(2)!r}D - 2D * {z} * {series}"


def signatures(weights: DataFrame, keys: list[str], sides: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and a string for each side: 4 hex digits for each draw, from rows (keys, term: long, a weight column for each side).

    A weight that is null or not over 0 leaves the term out of that side. A side without terms is all `ffff`.
    The draws go in blocks of WIDE columns so that the code for each row stays small enough to be compiled; the only state
    are the minima. A weight of 1 has t = 0, without a division.
    """
    blocks = -(-samples // WIDE)
    w, each = [f"_w_{s}" for s in sides], range(WIDE)
    col = lambda sql, name: F.expr(sql).alias(name)
    both = [(x, k, j) for j in each for x, k in (("r", f"_h{j}"), ("c", f"_g{j}"))]
    step = lambda x, k, j: _gamma(k, f"_n{x}{j}", f"_z{x}{j}")
    rows = weights.select(*keys, "term", *(F.when(F.col(s) > 0, F.ln(F.col(s).cast("double"))).alias(f"_w_{s}") for s in sides), F.explode(F.array(*map(F.lit, range(blocks)))).alias("_b"))
    own = [*keys, "_b", *w]
    rows = rows.select(*own, *(col(f"xxhash64(term, _b * {WIDE} + {j})", f"_h{j}") for j in each))
    rows = rows.select(*own, *(f"_h{j}" for j in each), *(col(f"xxhash64(_h{j})", f"_g{j}") for j in each))
    rows = rows.select(*own, *(col(step(*x)[0], f"_n{x[0]}{x[2]}") for x in both), *(col(step(*x)[1], f"_x{x[0]}{x[2]}") for x in both), *(col(f"(hash(_g{j}) & 16777215) * {2.0**-24!r}D", f"_u{j}") for j in each))
    rows = rows.select(*own, *(f"_n{x}{j}" for x, _, j in both), *(col(f"(_x{x}{j} - 0.5D) / (_x{x}{j} + 0.5D)", f"_z{x}{j}") for x, _, j in both), *(f"_u{j}" for j in each))
    rows = rows.select(*own, *(col(step(*x)[2] if x[0] == "r" else f"ln({step(*x)[2]})", f"_{x[0]}{x[2]}") for x in both), *(f"_u{j}" for j in each))
    rows = rows.select(*own, *(col(f"_c{j} - _r{j} * (1D - _u{j})", f"_a{j}") for j in each), *(f"_r{j}" for j in each), *(f"_u{j}" for j in each))
    value = "case when _w_{s} = 0D then _a{j} when _w_{s} > -1e300D then _a{j} - _r{j} * floor(_w_{s} / _r{j} + _u{j}) end"
    least = [F.min(F.expr(value.format(s=s, j=j))).alias(f"_{s}{j}") for s in sides for j in each]
    found = rows.groupBy(*keys, "_b").agg(*least)
    hexed = lambda c: f"lpad(lower(hex(coalesce(shiftrightunsigned(xxhash64(floor({c} * 1e9D)), 48) % 65535, 65535))), 4, '0')"
    found = found.select(*keys, "_b", *(F.expr(f"case when _{s}0 is null then '{'ffff' * WIDE}' else concat({', '.join(hexed(f'_{s}{j}') for j in each)}) end").alias(s) for s in sides))
    whole = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", *sides))).alias("_all"))
    return whole.select(*keys, *(F.substring(F.array_join(F.col("_all").getField(s), ""), 1, 4 * samples).alias(s) for s in sides))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of draws in which two fingerprints, as bytes, agree."""
    same = " + ".join(f"cast(substr({a}, {2 * j + 1}, 2) = substr({b}, {2 * j + 1}, 2) as int)" for j in range(samples))
    return F.expr(f"cast({same} as double) / {samples}")


def _order(docs: DataFrame) -> DataFrame:
    """(k, q, before_k, before_q): each key once, with its greatest q, and the key and q before it; the last is before the first.

    Keys are ranged, so only the last key of each partition meets in one place.
    """
    ids = docs.groupBy("k").agg(F.max("q").alias("q")).repartitionByRange("k").withColumn("p", F.spark_partition_id())
    ids = durable(ids)
    edge = ids.groupBy("p").agg(F.max(F.struct("k", "q")).alias("z"))
    line = Window.partitionBy(F.lit(0)).orderBy("p")
    edge = edge.select("p", F.coalesce(F.lag("z").over(line), F.last("z").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("y"))
    own = ids.withColumn("b", F.lag(F.struct("k", "q")).over(Window.partitionBy("p").orderBy("k")))
    full = own.join(F.broadcast(edge), "p").withColumn("b", F.coalesce("b", "y"))
    return full.select("k", "q", F.col("b.k").alias("before_k"), F.col("b.q").alias("before_q"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, spread: int = 4) -> DataFrame:
    """A row (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document
    in ascending doc_id (after the last: the first). near_edited and near_next: likeness to the edited text's fingerprint
    and to the next document's. A null text is empty; texts without words have equal fingerprints, unlike any other. A
    null doc_id (or the least long) comes before all others. Rows that repeat a doc_id each give a row and have the same next document; the
    one with the least hash of its text stands for its doc_id as the next of others. One document alone is its own next.
    An empty table gives an empty result; other columns are ignored.
    Texts are dealt by id once (both uses read the same exchange) and stay there; their terms are counted and sampled
    without another exchange.
    """
    parts = spread * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select(F.expr(_KEY).alias("k"), "text", F.length("text").cast("long").alias("n"))
    order = durable(_order(base.select("k", F.expr("n div 4").alias("q"))))
    dealt = base.repartition(parts, "k").withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("text"), "n")))
    heads = dealt.where("o = 1").join(order.select("k", "before_k", "before_q"), "k")
    heads = heads.select(F.col("before_k").alias("k"), F.expr("substring(text, 1, cast(before_q as int))").alias("head")).repartition(parts, "k")
    both = dealt.join(heads, "k").withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 4 as int)), substring(head, 1, cast(n div 4 as int)))"))
    plain = both.select("k", "o", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    each = both.select("k", "o", F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("text").alias("t")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y"), F.col("edited").alias("t")))).alias("s"))
    each = each.select("k", "o", "s.x", "s.y", F.explode(words("s.t")).alias("word")).where("word <> ''")
    counted = each.groupBy("k", "o", F.xxhash64("word").alias("term")).agg(F.sum("x").alias("own"), F.sum("y").alias("edited"))
    signed = signatures(counted, ["k", "o"], ["own", "edited"], samples)
    none = F.lit("ffff" * samples)
    signed = plain.join(signed, ["k", "o"], "left").withColumns({c: F.unhex(F.coalesce(c, none)) for c in ("own", "edited")})
    signed = durable(signed)
    after = signed.where("o = 1").select("k", F.col("own").alias("next")).join(order, "k").select(F.col("before_k").alias("k"), "next")
    out = signed.join(after, "k")
    digits = lambda c: F.lower(F.hex(c))
    return out.select(F.expr(_ID).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", digits("own").alias("fingerprint"), digits("edited").alias("edited_fingerprint"), likeness("own", "edited", samples).alias("near_edited"), likeness("own", "next", samples).alias("near_next"))


def op8(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
