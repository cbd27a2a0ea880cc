"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import stored, table

#: Exponents that flatten the corpus's own shares into the targets, for each marginal.
FLATTEN = {"source": 0.7, "lang": 0.5, "topic": 0.7}
#: Share of the corpus's tokens that the sample has in expectation.
RATE = 0.5
SEED, ROUNDS, TOLERANCE = 20, 200, 1e-9
#: Cells that the driver fits; more are fitted as a distributed table.
DRIVER_CELLS = 100_000

#: Topics told from a text's form, the first that holds.
TOPIC = r"""case when text is null or trim(text) = '' then 'none'
  when lower(text) like '%licen%' then 'legal'
  when text like '% | %' then 'tabular'
  when length(translate(text, '0123456789', '')) < 0.9 * length(text) then 'numeric'
  when length(text) >= 4000 then 'long' else 'short' end"""
#: Estimated tokens of a text: four characters each, one at least.
TOKENS = "greatest(1L, cast(ceil(coalesce(length(text), 0) / 4) as bigint))"
_NULL = "\x00null"


def _targets(sums: dict, power: float) -> dict:
    flat = {k: v**power for k, v in sums.items()}
    return {k: v / sum(flat.values()) for k, v in flat.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted weights of cells, with shares of each marginal as in targets: each round scales the cells to one marginal after the other.

    A round that changes no factor by `tolerance` ends it; after `rounds` rounds the last weights stand, with a warning.
    """
    w = cells / cells.sum()
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weights=w, minlength=len(target))
            factor = np.divide(target, have, out=np.ones_like(target), where=have > 0)
            off = max(off, float(np.abs(factor - 1).max()))
            w = w * factor[code]
        if off < tolerance:
            return w
    warnings.warn(f"the marginals are still off by {off:.2g} after {rounds} rounds", stacklevel=2)
    return w


def calibrated(tokens: np.ndarray, fitted: np.ndarray, rate: float) -> np.ndarray:
    """Probabilities in proportion to fitted / tokens, at most 1, so that the expected tokens are `rate` of all.

    Cells without weight get 0. If those with weight hold fewer tokens than that, all of theirs are taken.
    """
    g = np.divide(fitted, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    some = np.flatnonzero(g > 0)
    order = some[np.argsort(-g[some], kind="stable")]
    t, s = tokens[order], (g * tokens)[order]
    full, rest = np.cumsum(t) - t, np.cumsum(s[::-1])[::-1]
    c = (rate * tokens.sum() - full) / rest
    fits = np.flatnonzero(c * g[order] <= 1)
    p = np.minimum(1.0, c[fits[0]] * g) if len(fits) else (g > 0).astype(float)
    if not np.isfinite(p).all():
        raise ValueError("probabilities are not finite")
    return p


def _fit_on_driver(cells: DataFrame, dims: list[str], powers: dict[str, float], targets: dict[str, dict] | None, rate: float, rounds: int = ROUNDS) -> DataFrame:
    rows = cells.orderBy(*dims).toArrow()
    tokens = rows.column("tokens").to_numpy().astype(float)
    codes, wanted = [], []
    for d in dims:
        keys, code = np.unique(np.array(rows.column(d).to_pylist(), object).astype(str), return_inverse=True)
        sums = dict(zip(keys.tolist(), np.bincount(code, weights=tokens).tolist(), strict=True))
        goal = (targets or {}).get(d) or _targets(sums, powers[d])
        codes.append(code)
        wanted.append(np.array([goal.get(k, 0.0) for k in keys.tolist()]))
    fitted = rake(tokens, codes, [x / max(x.sum(), 1e-300) for x in wanted], rounds)
    p = calibrated(tokens, fitted, rate)
    out = [(*(rows.column(d)[i].as_py() for d in dims), float(fitted[i] / (tokens[i] / tokens.sum())), float(p[i])) for i in range(len(tokens))]
    return cells.sparkSession.createDataFrame(out, ", ".join([*(f"`{d}` string" for d in dims), "weight double", "p double"]))


def _fit_distributed(cells: DataFrame, dims: list[str], powers: dict[str, float], targets: dict[str, dict] | None, rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same fit with the same rounds and tolerance, with the cells as a table: each marginal's sums are joined back, a round is written and read again."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now, goals = cells.withColumn("w", F.col("tokens") / F.lit(total)), {}
    for d in dims:
        given = (targets or {}).get(d)
        goal = cells.groupBy(F.col(d).alias("k")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[d])).alias("t"))
        if given:
            named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], "k string, t double")
            goal = goal.select("k").join(named, "k", "left").fillna(0.0, ["t"])
        goal = stored(goal)
        goals[d] = goal.withColumn("t", F.col("t") / F.lit(goal.agg(F.sum("t")).first()[0] or 1.0))
    worst = None
    for _ in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for d in dims:
            have = now.groupBy(F.col(d).alias("k")).agg(F.sum("w").alias("have")).join(goals[d], "k").select("k", F.when(F.col("have") > 0, F.col("t") / F.col("have")).otherwise(1.0).alias("f"))
            now = now.join(have, F.col(d) == F.col("k")).select(*dims, "tokens", (F.col("w") * F.col("f")).alias("w"), F.greatest("off", F.abs(F.col("f") - 1)).alias("off"))
        now = stored(now)
        worst = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if worst is None or worst < tolerance:
            break
    else:
        warnings.warn(f"the marginals are still off by {worst:.2g} after {rounds} rounds", stacklevel=2)
    now, c, budget = now.withColumn("g", F.col("w") / F.col("tokens")), 0.0, rate * total
    while True:
        capped = F.lit(c) * F.col("g") >= 1
        full, rest = now.where("g > 0").agg(F.sum(F.when(capped, F.col("tokens"))), F.sum(F.when(~capped, F.col("w")))).first()
        new = (budget - (full or 0)) / rest if rest else c
        if new <= c * (1 + 1e-15):
            break
        c = new
    p = F.when(F.col("g") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("g")) if rest else F.lit(1.0)).otherwise(0.0)
    return now.select(*dims, (F.col("w") / (F.col("tokens") / F.lit(total or 1.0))).alias("weight"), p.alias("p"))


def uniform(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that an id and the seed fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("long")), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, flatten: dict[str, float] | None = None, targets: dict[str, dict] | None = None, rate: float = RATE, topic: str = TOPIC, tokens: str = TOKENS, seed: int = SEED, id_col: str = "doc_id", driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of docs with all their columns and four more at the end: _topic, _tokens, _weight, _p.

    topic and tokens are SQL expressions over docs; a table that has them gives its own columns. The cells are the
    combinations of source, lang and topic. Their token sums are raked to marginals: those in `targets`
    (dimension to value to share; a value not named gets 0), else the corpus's own, flattened by a power. _weight: fitted
    share of a cell over its own share. _p: a row's probability, the same for all of a cell, in proportion to _weight, at
    most 1, with `rate` of all tokens expected (or all tokens of the cells with weight, if they hold fewer). Up to
    driver_cells cells are fitted in the driver, more as a table, with the same rounds and tolerance.
    Null values of source, lang and topic are a category each; a null or empty text has one token. Rows of equal id share
    their draw; null ids share one. Where docs has a column of an added name, all four start with one more underscore
    than any column. An empty table gives an empty result.
    """
    dims, names = ["source", "lang", "topic"], docs.columns
    mark = "_"
    if {f"_{x}" for x in ("topic", "tokens", "weight", "p")} & {n.lower() for n in names}:
        mark = "_" * (1 + max(len(n) - len(n.lstrip("_")) for n in names))
    inner = mark + "_" * (1 + max(map(len, names)))  # starts no column's name
    whole = {d: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(_NULL)) for d in dims[:2]} | {"topic": F.coalesce(F.expr(topic).cast("string"), F.lit(_NULL))}
    named = docs.select(*(F.col(f"`{n}`") for n in names), F.expr(topic).alias(f"{mark}topic"), F.expr(tokens).cast("long").alias(f"{mark}tokens"), *(c.alias(f"{inner}k_{d}") for d, c in whole.items()))
    cells = stored(named.groupBy(*(F.col(f"{inner}k_{d}").alias(d) for d in dims)).agg(F.sum(f"{mark}tokens").alias("tokens")))
    n, powers = cells.count(), flatten or FLATTEN
    if n <= driver_cells:
        fitted = F.broadcast(_fit_on_driver(cells, dims, powers, targets, rate, rounds)) if n else cells.select(*dims, F.lit(0.0).alias("weight"), F.lit(0.0).alias("p"))
    else:
        fitted = stored(_fit_distributed(cells, dims, powers, targets, rate, rounds))
    fitted = fitted.select(*(F.col(d).alias(f"{inner}f_{d}") for d in dims), F.col("weight").alias(f"{mark}weight"), F.col("p").alias(f"{mark}p"))
    on = [F.col(f"{inner}k_{d}") == F.col(f"{inner}f_{d}") for d in dims]
    drawn = named.join(fitted, on).where(uniform(id_col, seed) < F.col(f"{mark}p"))
    return drawn.select(*(F.col(f"`{n}`") for n in names), *(f"{mark}{x}" for x in ("topic", "tokens", "weight", "p")))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_p", 6).alias("p"))
