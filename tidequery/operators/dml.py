"""INSERT, UPDATE and DELETE as DataFrame plans that make new files; files without a changed row are kept as they are."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidequery.errors import CONSTRAINT, QueryError
from tidequery.plans.frontend import Bound, Token, closing, dialect, find, name_of, parted, slots, text_of
from tidequery.sources.store import Column, State, Store, Table

_ORD = "_tq_ord"


@dataclass(frozen=True)
class WriteResult:
    """affected: rows inserted, updated or deleted. last_id: the last automatic or given integer key of an INSERT, else 0."""

    affected: int = 0
    last_id: int = 0


@dataclass
class Context:
    """What a statement works on: the store, a session with the state's views, and the state."""

    store: Store
    session: SparkSession
    state: State
    sql: str


def _target(cx: Context, t: Token) -> Table:
    if found := cx.state.table(name_of(t)):
        return found
    raise QueryError(f"no such table: {name_of(t)}", cx.sql)


def _constant(ts: list[Token], args: dict[str, object]) -> tuple[bool, object]:
    """(True, value) of a parameter or a plain literal."""
    if len(ts) == 2 and ts[0].text == "-" and ts[1].kind == "number":
        ok, v = _constant(ts[1:], args)
        return ok, -v
    if len(ts) != 1:
        return False, None
    t = ts[0]
    if t.kind == "param":
        return True, args[t.text[1:]]
    if t.kind == "string":
        return True, t.text[1:-1].replace("''", "'")
    if t.kind == "number":
        return True, int(t.text) if t.text.isdigit() else float(t.text)
    if t.kind == "blob":
        return True, bytes.fromhex(t.text[2:-1])
    return (True, None) if t.up == "NULL" else (False, None)


_PYTHON = {"BIGINT": int, "DOUBLE": (int, float), "STRING": str, "BINARY": bytes}


def _given(t: Table, columns: list[Column], rows: list[list[object]], cx: Context) -> DataFrame:
    """A DataFrame of Python rows with an ordinal; values of another type than the column's are cast."""
    fits = all(v is None or isinstance(v, _PYTHON.get(c.type, ())) and not (c.type == "BIGINT" and isinstance(v, float)) for r in rows for c, v in zip(columns, r, strict=True))
    names = [f"c{k}" for k in range(len(columns))]
    if fits:
        data = [(k, *(float(v) if c.type == "DOUBLE" and v is not None else v for c, v in zip(columns, r, strict=True))) for k, r in enumerate(rows)]
        df = cx.session.createDataFrame(data, f"{_ORD} bigint, " + ", ".join(f"{n} {c.type}" for n, c in zip(names, columns, strict=True)))
    else:
        text = lambda v: v if v is None or isinstance(v, bytes) else str(v)
        kinds = ["BINARY" if any(isinstance(r[k], bytes) for r in rows) else "STRING" for k in range(len(columns))]
        data = [(n, *(v.encode() if kinds[k] == "BINARY" and isinstance(v, str) else v for k, v in enumerate(map(text, r)))) for n, r in enumerate(rows)]
        df = cx.session.createDataFrame(data, f"{_ORD} bigint, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return df.coalesce(max(1, len(rows) // 100_000)).select(_ORD, *(F.col(n).cast(c.type).alias(c.name) for n, c in zip(names, columns, strict=True)))


def _ordinals(df: DataFrame, cx: Context) -> DataFrame:
    """df with an ordinal from 0, by partition and place: the rows of each partition are counted, not brought together."""
    if _ORD in df.columns:
        return df
    staged = _staged(df.withColumn("_tq_m", F.monotonically_increasing_id()), cx)
    counts = sorted((r[0], r[1]) for r in staged.groupBy(F.shiftright("_tq_m", 33).alias("p")).count().collect())
    base, at = [], 0
    for p, n in counts:
        base.append((p, at))
        at += n
    bases = cx.session.createDataFrame(base, "_tq_p bigint, _tq_b bigint")
    return staged.join(F.broadcast(bases), F.shiftright("_tq_m", 33) == F.col("_tq_p")).withColumn(_ORD, F.col("_tq_b") + F.col("_tq_m").bitwiseAND((1 << 33) - 1)).drop("_tq_m", "_tq_p", "_tq_b")


def _staged(df: DataFrame, cx: Context) -> DataFrame:
    """df, written once and read from there, so that what is checked is what is written."""
    out = f"{cx.store.root}/tables/_staged/{uuid.uuid4().hex}"
    df.write.parquet(out)
    return cx.session.read.schema(df.schema).parquet(out)


def _broken(t: Table) -> list[tuple[str, object]]:
    """(what, condition) of each row constraint's violation."""
    out = [(f"NOT NULL {t.name}.{c.name}", F.col(f"`{c.name}`").isNull()) for c in t.columns if c.notnull]
    return out + [(f"CHECK {t.name}", ~F.coalesce(F.expr(c).cast("boolean"), F.lit(True))) for c in t.checks]


def _all_set(cols: tuple[str, ...]):
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])


def _fail(what: str, cx: Context) -> None:
    raise QueryError(f"{what} constraint failed", cx.sql, code=CONSTRAINT)


def _checked(t: Table, df: DataFrame, old: DataFrame | None, cx: Context, uniques: tuple) -> int:
    """The number of new rows; raises for rows that break a constraint of their own or with each other or with old rows."""
    broken = _broken(t)
    counts = df.agg(F.count("*"), *(F.count(F.when(c, 1)) for _, c in broken)).first()
    for (what, _), n in zip(broken, counts[1:], strict=True):
        if n:
            _fail(what, cx)
    for u in uniques:
        keys = df.where(_all_set(u)).select(*(F.col(f"`{c}`") for c in u))
        many = keys.groupBy(*keys.columns).count().where("count > 1").select(*keys.columns)
        if old is not None:
            many = many.unionByName(keys.join(old.select(*(F.col(f"`{c}`") for c in u)), list(u), "left_semi"))
        if not many.isEmpty():
            _fail(f"UNIQUE {t.name}.{', '.join(u)}", cx)
    return counts[0]


def insert(cx: Context, b: Bound, rows: list[dict[str, object]] | None = None) -> tuple[Table, WriteResult, bool]:
    """INSERT [OR IGNORE | OR REPLACE] INTO t [(columns)] VALUES ... | SELECT ... [ON CONFLICT ... DO NOTHING]; rows: the parameters of each of a batch."""
    ts, mode = b.ts, "ABORT"
    lead = find(ts, "INSERT") if find(ts, "INSERT") >= 0 else find(ts, "REPLACE")
    with_, ts = ts[:lead], ts[lead:]
    at = 1
    if ts[0].up == "REPLACE":
        mode = "REPLACE"
    elif ts[1].up == "OR":
        mode, at = ts[2].up, 3
    t = _target(cx, ts[at + 1])
    at += 2
    columns = list(t.columns)
    if at < len(ts) and ts[at].text == "(" and (at + 1 < len(ts) and ts[at + 1].up not in ("SELECT", "WITH")):
        z = closing(ts, at)
        wanted = [name_of(p[0]) for p in parted(ts[at + 1 : z])]
        if missing := [c for c in wanted if not t.column(c)]:
            raise QueryError(f"no such column: {missing[0]}", cx.sql)
        columns, at = [t.column(c) for c in wanted], z + 1
    body, conflict = ts[at:], find(ts, "CONFLICT", at)
    if conflict > 0:
        do = find(ts, "DO", conflict)
        body = ts[at : conflict - 1]
        if ts[do + 1].up != "NOTHING":
            return _upsert(cx, t, columns, body, ts[conflict:do], ts[do + 1 :], b, rows)
        mode = "IGNORE"
    if mode not in ("ABORT", "IGNORE", "REPLACE", "FAIL", "ROLLBACK"):
        raise QueryError(f"OR {mode} isn't known", cx.sql)
    return _insert(cx, t, mode, _rows(cx, t, columns, with_, body, b.args, rows))


def _rows(cx: Context, t: Table, columns: list[Column], with_: list[Token], body: list[Token], args: dict, rows: list[dict] | None) -> DataFrame:
    """The rows to insert with all columns of t (a missing key stays null) and, where they come in an order, an ordinal."""
    if body and body[0].up == "VALUES":
        exprs = [parted(g[1 : closing(g, 0)]) for g in parted(body[1:])]
        if any(len(e) != len(columns) for e in exprs):
            raise QueryError(f"{len(columns)} values are needed", cx.sql)
        plain = [[_constant(e, a) for e in g] for a in (rows or [args]) for g in exprs]
        if all(ok for g in plain for ok, _ in g):
            df = _given(t, columns, [[v for _, v in g] for g in plain], cx)
        else:
            one = lambda a, n: [cx.session.sql(f"SELECT {n * len(exprs) + k}L AS {_ORD}, " + ", ".join(f"CAST({text_of(dialect(e))} AS {c.type}) AS `{c.name}`" for e, c in zip(g, columns, strict=True)), args=a) for k, g in enumerate(exprs)]
            df = reduce(DataFrame.unionByName, [x for n, a in enumerate(rows or [args]) for x in one(a, n)])
    elif body and [x.up for x in body] == ["DEFAULT", "VALUES"]:
        columns, df = [], cx.session.range(1).select(F.col("id").alias(_ORD))
    else:
        each = [cx.session.sql(text_of(dialect([*with_, *body])), args=a) for a in (rows or [args])]
        if len(each[0].columns) != len(columns):
            raise QueryError(f"{len(columns)} columns are needed", cx.sql)
        df = reduce(DataFrame.union, each).toDF(*(c.name for c in columns))
        df = df.select(*(F.col(f"`{c.name}`").cast(c.type) for c in columns))
    have = {c.name for c in columns}
    extra = [(F.expr(c.default) if c.default else F.lit(None)).cast(c.type).alias(c.name) for c in t.columns if c.name not in have]
    keep = [_ORD] if _ORD in df.columns else []
    return df.select(*keep, *(F.col(f"`{c.name}`") for c in columns), *extra).select(*keep, *(F.col(f"`{c.name}`") for c in t.columns))


def _named(u: tuple[str, ...]) -> list:
    return [F.col(f"`{c}`") for c in u]


def _accepted(cx: Context, t: Table, df: DataFrame, old: DataFrame | None, uniques: tuple) -> DataFrame:
    """The rows that INSERT OR IGNORE puts in one after the other: those that break no constraint of their own and have no key of an old row or of a row put in before.

    Rows without a rival before them all go in at once and take their later rivals out; what is left is judged again. With
    one key, or where keys go together, that is one round.
    """
    names = [f"`{c.name}`" for c in t.columns]
    for _, bad in _broken(t):
        df = df.where(~bad)
    for u in uniques if old is not None else ():
        df = df.join(old.select(*_named(u)), list(u), "left_anti").select(_ORD, *names)
    if not uniques:
        return df
    rest, out = _staged(df.select(_ORD, *names), cx), None
    while True:
        free = rest
        for u in uniques:
            best = rest.where(_all_set(u)).groupBy(*_named(u)).agg(F.min(_ORD).alias("_tq_first"))
            free = free.join(best, list(u), "left").where(F.col("_tq_first").isNull() | (F.col(_ORD) == F.col("_tq_first"))).select(_ORD, *names)
        free = _staged(free, cx)
        out = free if out is None else out.unionByName(free)
        if len(uniques) == 1:
            return out
        rest = rest.join(free.select(_ORD), _ORD, "left_anti")
        for u in uniques:
            rest = rest.join(free.select(*_named(u)), list(u), "left_anti")
        rest = _staged(rest.select(_ORD, *names), cx)
        if rest.isEmpty():
            return out


def _replacing(cx: Context, t: Table, given: DataFrame, old: DataFrame | None, uniques: tuple) -> tuple[Table, DataFrame, bool]:
    """(t without the old rows that go, the rows that stay, whether any old row went) of INSERT OR REPLACE.

    Every row is put in for a while: it takes out all rows before it, old or new, that have a key of it.
    """
    names, df, kept, gone = [f"`{c.name}`" for c in t.columns], given, t, 0
    for u in uniques:
        best = given.where(_all_set(u)).groupBy(*_named(u)).agg(F.max(_ORD).alias("_tq_last"))
        df = df.join(best, list(u), "left").where(F.col("_tq_last").isNull() | (F.col(_ORD) == F.col("_tq_last"))).select(_ORD, *names)
    if old is not None and uniques:

        def replaced(files: tuple[str, ...]) -> DataFrame:
            hit, named = F.lit(False), _filed(cx, t, files)
            for k, u in enumerate(uniques):
                mark = given.where(_all_set(u)).select(*_named(u)).distinct().withColumn(f"_tq_u{k}", F.lit(True))
                named = named.join(mark, list(u), "left")
                hit = hit | F.coalesce(F.col(f"_tq_u{k}"), F.lit(False))
            return named.withColumn("_tq_hit", hit)

        kept, gone = _rewritten(cx, t, replaced, names, None)
    return kept, df, gone > 0


def _insert(cx: Context, t: Table, mode: str, df: DataFrame) -> tuple[Table, WriteResult, bool]:
    old = cx.store.load(t, cx.session) if t.files else None
    names, uniques = [f"`{c.name}`" for c in t.columns], t.uniques
    if t.rowid or mode in ("IGNORE", "REPLACE"):
        df = _ordinals(df, cx)
    if t.rowid:
        key = F.col(f"`{t.rowid}`")
        given = df.agg(F.max(key)).first()[0]
        df = df.withColumn(t.rowid, F.coalesce(key, F.lit(max(t.high, given or 0)) + 1 + F.col(_ORD)))
        if given is None:  # no old row can have a key that follows the greatest, so the table isn't read for it
            uniques = tuple(u for u in uniques if u != (t.rowid,))
    kept, changed, affected = t, False, None
    if mode == "IGNORE":
        df = _accepted(cx, t, df, old, uniques)
    elif mode == "REPLACE":
        affected = _checked(t, df, None, cx, ())
        kept, df, changed = _replacing(cx, t, df, old, uniques)
    else:
        affected = _checked(t, df, old, cx, uniques)
    ends = (F.max(f"`{t.rowid}`"), F.max_by(f"`{t.rowid}`", _ORD)) if t.rowid else (F.lit(0), F.lit(0))
    size, top, last = df.agg(F.count("*"), *ends).first()
    if not size:
        return kept, WriteResult(0, 0), changed
    if t.rowid:
        kept = replace(kept, high=max(kept.high, top or 0))
    files = cx.store.write(t, df.select(*names))
    return replace(kept, files=kept.files + files, rows=kept.rows + size), WriteResult(size if affected is None else affected, last or 0), True


def _filed(cx: Context, t: Table, files: tuple[str, ...]) -> DataFrame:
    """Rows of these files with their file, which is a column of the scan, so conditions still reach the scan."""
    return cx.store.load(t, cx.session, files).withColumn("_tq_file", F.col("_metadata.file_path"))


def _bare(file: str) -> str:
    """A file's path without scheme."""
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", file)


def _rewritten(cx: Context, t: Table, marked: Callable[[tuple[str, ...]], DataFrame], names: list[str], values: Callable[[DataFrame], DataFrame] | None, hits: DataFrame | None = None) -> tuple[Table, int]:
    """t without (values None) or with changed rows where _tq_hit; only files that hold such rows are read again and written anew.

    marked(files) gives the rows of these files with _tq_file and _tq_hit; hits: the hit rows of all files, if a plainer
    plan than marked's finds them.
    """
    hits = marked(t.files).where("_tq_hit") if hits is None else hits
    touched = {_bare(unquote(r[0])): r[1] for r in hits.groupBy("_tq_file").count().collect()}
    n = sum(touched.values())
    if not n:
        return t, 0
    mine, rest = tuple(f for f in t.files if _bare(f) in touched), tuple(f for f in t.files if _bare(f) not in touched)
    if len(mine) != len(touched):
        raise QueryError("the files of changed rows can't be told", cx.sql)
    size = t.rows - (n if values is None else 0)
    files = ()
    if values is not None or cx.store.load(t, cx.session, mine).count() > n:
        rows = marked(mine)
        new = rows.where(~F.col("_tq_hit")).select(*names) if values is None else values(rows)
        files = cx.store.write(t, new.coalesce(len(mine)))
    return replace(t, files=rest + files, rows=size), n


def _updated(cx: Context, t: Table, changed: Callable[[tuple[str, ...]], DataFrame], to: Iterable[str], hits: DataFrame | None = None) -> tuple[Table, int]:
    """t with the rows of changed(files), whose columns `to` differ, in place of the old ones. The files written are what is checked, so an expression is evaluated once."""
    names, to = [f"`{c.name}`" for c in t.columns], set(to)
    out, n = _rewritten(cx, t, changed, names, lambda rows: rows.select(*names), hits)
    if n:
        old, uniques = set(t.files), tuple(u for u in t.uniques if to & set(u))
        new, rest = tuple(f for f in out.files if f not in old), tuple(f for f in out.files if f in old)
        _checked(t, cx.store.load(t, cx.session, new), cx.store.load(t, cx.session, rest) if uniques and rest else None, cx, uniques)
    if n and t.rowid in to:
        out = replace(out, high=max(out.high, cx.store.load(t, cx.session, new).agg(F.max(f"`{t.rowid}`")).first()[0] or 0))
    return out, n


def _marked(cx: Context, t: Table, files: tuple[str, ...], where: list[Token], args: dict) -> DataFrame:
    """Rows of these files of t with their file and whether the condition holds."""
    _filed(cx, t, files).createOrReplaceTempView("_tq_target")
    cond = f"coalesce(CAST(({text_of(dialect(where))}) AS BOOLEAN), false)" if where else "true"
    return cx.session.sql(f"SELECT *, {cond} AS _tq_hit FROM _tq_target AS `{t.name}`", args=args)


def _hits(cx: Context, t: Table, where: list[Token], args: dict) -> DataFrame:
    """The files of rows for which the condition holds, as a filter that reaches the scan."""
    _filed(cx, t, t.files).createOrReplaceTempView("_tq_target")
    cond = f" WHERE CAST(({text_of(dialect(where))}) AS BOOLEAN)" if where else ""
    return cx.session.sql(f"SELECT _tq_file FROM _tq_target AS `{t.name}`{cond}", args=args)


def update(cx: Context, b: Bound) -> tuple[Table, WriteResult, bool]:
    """UPDATE t SET column = expression, ... [FROM source] [WHERE condition]."""
    ts = b.ts
    t, set_, where = _target(cx, ts[1]), find(ts, "SET"), find(ts, "WHERE")
    if not t.files:
        return t, WriteResult(), False
    sets, end = {}, where if where > 0 else len(ts)
    source = find(ts[:end], "FROM")
    for part in parted(ts[set_ + 1 : source if source > 0 else end]):
        c = t.column(name_of(part[0]))
        if not c:
            raise QueryError(f"no such column: {name_of(part[0])}", cx.sql)
        sets[c.name] = part[2:]
    key = (t.rowid,) if t.rowid else next(iter(t.uniques), ())
    if source > 0 and (not key or set(key) & set(sets)):
        raise QueryError("UPDATE ... FROM needs a key that it doesn't change", cx.sql)
    exprs = [f"CASE WHEN _tq_hit THEN CAST({text_of(dialect(sets[c.name]))} AS {c.type}) ELSE `{c.name}` END AS `{c.name}`" if c.name in sets else f"`{c.name}`" for c in t.columns]

    def changed(files: tuple[str, ...]) -> DataFrame:
        if source > 0:
            _filed(cx, t, files).createOrReplaceTempView("_tq_target")
            cond = f" WHERE {text_of(dialect(ts[where + 1 :]))}" if where > 0 else ""
            to = list(sets)
            found = [f"CAST({text_of(dialect(sets[c]))} AS {t.column(c).type}) AS _v{k}" for k, c in enumerate(to)]
            met = cx.session.sql(f"SELECT {', '.join(f'`{t.name}`.`{c}` AS `{c}`' for c in key)}, {', '.join(found)} FROM _tq_target AS `{t.name}` CROSS JOIN {text_of(dialect(ts[source + 1 : end]))}{cond}", args=b.args)
            one = met.groupBy(*(F.col(f"`{c}`") for c in key)).agg(F.min(F.struct(*(f"_v{k}" for k in range(len(to))))).alias("_tq_v"))
            rows = _filed(cx, t, files).join(one, list(key), "left").withColumn("_tq_hit", F.col("_tq_v").isNotNull())
            return rows.select("_tq_file", "_tq_hit", *(F.when(F.col("_tq_hit"), F.col(f"_tq_v._v{to.index(c.name)}")).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in sets else F.col(f"`{c.name}`") for c in t.columns))
        _marked(cx, t, files, ts[where + 1 :] if where > 0 else [], b.args).createOrReplaceTempView("_tq_marked")
        return cx.session.sql(f"SELECT _tq_file, _tq_hit, {', '.join(exprs)} FROM _tq_marked AS `{t.name}`", args=b.args)

    out, n = _updated(cx, t, changed, sets, None if source > 0 else _hits(cx, t, ts[where + 1 :] if where > 0 else [], b.args))
    return out, WriteResult(n), n > 0


def delete(cx: Context, b: Bound) -> tuple[Table, WriteResult, bool]:
    """DELETE FROM t [WHERE condition]."""
    ts = b.ts
    t, where = _target(cx, ts[2]), find(ts, "WHERE")
    if where < 0 or not t.files:
        n = t.rows
        return replace(t, files=(), rows=0, high=t.high if t.sticky else 0), WriteResult(n), n > 0
    out, n = _rewritten(cx, t, lambda files: _marked(cx, t, files, ts[where + 1 :], b.args), [f"`{c.name}`" for c in t.columns], None, _hits(cx, t, ts[where + 1 :], b.args))
    if n and t.rowid and not t.sticky:
        top = cx.store.load(out, cx.session).agg(F.max(f"`{t.rowid}`")).first()[0] if out.files else 0
        out = replace(out, high=top or 0)
    return out, WriteResult(n), n > 0


def _upsert(cx: Context, t: Table, columns: list[Column], body: list[Token], on: list[Token], do: list[Token], b: Bound, rows: list[dict] | None) -> tuple[Table, WriteResult, bool]:
    """INSERT ... ON CONFLICT (columns) DO UPDATE SET ... [WHERE ...]: rows in conflict update the old row, the others are inserted; rows: the parameters of each of a batch.

    Rows of different keys go in together, by one join. Of rows that share a key each sees what the one before made, so
    they go in rounds, the first of each key first; where SET only names excluded columns and there is no WHERE, two
    rounds do: the first rows, then the last ones.
    """
    a = next((k for k, x in enumerate(on) if x.text == "("), -1)
    if a < 0:
        raise QueryError("ON CONFLICT needs columns", cx.sql)
    keys = [t.column(name_of(p[0])).name for p in parted(on[a + 1 : closing(on, a)])]
    cut = find(do, "WHERE")
    where, do = (do[cut + 1 :], do[:cut]) if cut > 0 else ([], do)
    sets = {t.column(name_of(p[0])).name: p[2:] for p in parted(do[find(do, "SET") + 1 :])}
    df = _ordinals(_rows(cx, t, columns, [], body, b.args, rows), cx)
    ranked = df.withColumn("_tq_rank", F.row_number().over(Window.partitionBy(*_named(tuple(keys))).orderBy(_ORD)))
    most = df.where(_all_set(tuple(keys))).groupBy(*_named(tuple(keys))).count().agg(F.max("count")).first()[0] or 1
    plain = not where and all([x.up for x in v[:2]] == ["EXCLUDED", "."] and len(v) == 3 for v in sets.values())
    total, last, changed = 0, 0, False
    if most == 1:
        rounds = [df]
    else:
        ranked, names = _staged(ranked, cx), [_ORD, *(f"`{c.name}`" for c in t.columns)]
        free = ~_all_set(tuple(keys))
        rounds = [ranked.where((F.col("_tq_rank") == k) | free if k == 1 else (F.col("_tq_rank") == k) & ~free).select(*names) for k in range(1, (1 if plain else most) + 1)]
        if plain:
            late = ranked.where((F.col("_tq_rank") > 1) & ~free)
            best = late.groupBy(*_named(tuple(keys))).agg(F.max(_ORD).alias("_tq_last"))
            rounds.append(late.join(best, keys).where(F.col(_ORD) == F.col("_tq_last")).select(*names))
            total = late.count() - best.count()
    for rows_ in rounds:
        t, got, more = _merged(cx, t, rows_, keys, sets, where, b.args)
        total, last, changed = total + got.affected, got.last_id or last, changed or more
        cx = replace(cx, state=cx.state.with_table(t))
    return t, WriteResult(total, last), changed


def _merged(cx: Context, t: Table, df: DataFrame, keys: list[str], sets: dict[str, list[Token]], where: list[Token], args: dict) -> tuple[Table, WriteResult, bool]:
    """One round of an upsert, whose rows have different keys: the old rows are updated where the condition holds, the others inserted."""
    names, n = [f"`{c.name}`" for c in t.columns], 0
    fresh = df.join(cx.store.load(t, cx.session).select(*_named(tuple(keys))), keys, "left_anti").select(_ORD, *names)
    if t.files:
        df.select(F.lit(True).alias("_tq_in"), *names).createOrReplaceTempView("excluded")
        same = " AND ".join(f"`{t.name}`.`{k}` = excluded.`{k}`" for k in keys)
        hit = "coalesce(excluded._tq_in, false)" + (f" AND coalesce(CAST(({text_of(dialect(_qualified(where, t)))}) AS BOOLEAN), false)" if where else "")
        exprs = [f"CASE WHEN {hit} THEN CAST({text_of(dialect(_qualified(sets[c.name], t)))} AS {c.type}) ELSE `{t.name}`.`{c.name}` END AS `{c.name}`" if c.name in sets else f"`{t.name}`.`{c.name}`" for c in t.columns]
        query = f"SELECT `{t.name}`._tq_file AS _tq_file, {hit} AS _tq_hit, {', '.join(exprs)} FROM _tq_target AS `{t.name}` LEFT JOIN excluded ON {same}"

        def changed_rows(files: tuple[str, ...]) -> DataFrame:
            _filed(cx, t, files).createOrReplaceTempView("_tq_target")
            return cx.session.sql(query, args=args)

        t, n = _updated(cx, t, changed_rows, sets)
    out, got, more = _insert(cx, t, "ABORT", fresh)
    return out, WriteResult(n + got.affected, got.last_id), n > 0 or more


def _qualified(ts: list[Token], t: Table) -> list[Token]:
    """Bare columns of an upsert's SET mean the old row's."""
    out = []
    for k, x in enumerate(ts):
        bare = x.kind in ("word", "quoted") and t.column(name_of(x)) and (k == 0 or ts[k - 1].text != ".") and (k + 1 == len(ts) or ts[k + 1].text not in ".(")
        out += [Token("quoted", f"`{t.name}`"), Token("op", "."), x] if bare else [x]
    return out


def keyed_batch(cx: Context, ts: list[Token], sets: list[dict[str, object]]) -> tuple[Table, WriteResult, bool] | None:
    """A batch of UPDATE t SET c = ?, ... WHERE k = ? [AND ...] or DELETE FROM t WHERE k = ? [AND ...] as one join.

    None if the statement has another form, or if a later set could see what an earlier one changed.
    """
    where = find(ts, "WHERE")
    if where < 0 or ts[0].up not in ("UPDATE", "DELETE"):
        return None
    t = _target(cx, ts[1] if ts[0].up == "UPDATE" else ts[2])

    def pairs(parts: list[list[Token]]) -> list[tuple[Column, str]] | None:
        ok = [len(p) == 3 and t.column(name_of(p[0])) is not None and p[1].text == "=" and p[2].kind == "param" for p in parts]
        return [(t.column(name_of(p[0])), p[2].text[1:]) for p in parts] if all(ok) else None

    conds, at = [[]], where + 1
    for x in ts[at:]:
        if x.up == "AND":
            conds.append([])
        else:
            conds[-1].append(x)
    keys = pairs(conds)
    new = pairs(parted(ts[find(ts, "SET") + 1 : where])) if ts[0].up == "UPDATE" else []
    if keys is None or new is None or not t.files or {c.name for c, _ in new} & {c.name for c, _ in keys}:
        return None
    last = {tuple(s[p] for _, p in keys): k for k, s in enumerate(sets)}
    chosen = [sets[k] for k in sorted(last.values())]
    cols = [Column(f"_k{i}", c.type, "") for i, (c, _) in enumerate(keys)] + [Column(f"_v{i}", c.type, "") for i, (c, _) in enumerate(new)]
    df = _given(t, cols, [[s[p] for _, p in keys + new] for s in chosen], cx).drop(_ORD).withColumn("_tq_in", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(f"`{c.name}`") == F.col(f"_k{i}") for i, (c, _) in enumerate(keys)])
    marked = lambda files: _filed(cx, t, files).join(df, on, "left").withColumn("_tq_hit", F.coalesce("_tq_in", F.lit(False)))
    names = [f"`{c.name}`" for c in t.columns]
    if ts[0].up == "DELETE":
        out, n = _rewritten(cx, t, marked, names, None)
        if n and t.rowid and not t.sticky:
            out = replace(out, high=(cx.store.load(out, cx.session).agg(F.max(f"`{t.rowid}`")).first()[0] or 0) if out.files else 0)
        return out, WriteResult(n), n > 0
    to = {c.name: f"_v{i}" for i, (c, _) in enumerate(new)}
    changed = [F.when(F.col("_tq_hit"), F.col(to[c.name])).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in to else F.col(f"`{c.name}`") for c in t.columns]
    final = lambda files: marked(files).select("_tq_file", "_tq_hit", *changed)
    out, n = _updated(cx, t, final, to)
    return out, WriteResult(n), n > 0


def orphans(cx: Context, dirty: set[str], deferred: bool) -> str | None:
    """What foreign key is broken, of keys that touch a dirty table; deferred: at commit, all keys count."""
    for t in cx.state.tables.values():
        for k in t.keys:
            if not t.files or not ({t.name.lower(), k.parent.lower()} & dirty) or (k.deferred and not deferred):
                continue
            parent = cx.state.table(k.parent)
            child = cx.store.load(t, cx.session).where(_all_set(k.columns)).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(k.columns)))
            if parent is None:
                bad = child
            else:
                targets = k.targets or ((parent.rowid,) if parent.rowid else parent.uniques[0])
                have = cx.store.load(parent, cx.session).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(targets)))
                bad = child.join(have, [f"k{i}" for i in range(len(k.columns))], "left_anti")
            if not bad.isEmpty():
                return f"FOREIGN KEY {t.name}({', '.join(k.columns)})"
    return None


def named_sets(ts: list[Token], sets: list[list[object]], value: Callable[[object], object]) -> tuple[list[Token], list[dict[str, object]]]:
    """A batch's statement with named parameters and the values of each set."""
    out, n = slots(ts)
    return out, [{f"p{k}": value(v) for k, v in enumerate(s)} for s in sets]
