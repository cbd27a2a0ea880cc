"""Chat formatting: tool calls are linked with their results, ordered by dependency, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidequery.llm.common import durable, mapped, slices, stored, table

#: JSON types of a schema's fields and the Python types they take.
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name occurs twice")
    return out


def _no(x: str) -> float:
    raise ValueError(f"{x} is not JSON")


def parsed(text: str | None) -> object:
    """A JSON value; ValueError for what isn't strict JSON (also names that occur twice in an object, NaN and infinities)."""
    if text is None:
        raise ValueError("no arguments")
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no)


def canonical(value: object) -> str:
    """JSON with sorted names, no white space, characters as they are and whole floats as integers, so equal values are equal texts."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("a number out of range")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Schema keywords that are checked, and those that only describe.
_CHECKED = {"type", "enum", "const", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "anyOf", "allOf", "oneOf", "not"}
_TOLD = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def known(schema: object, at: str = "schema") -> None:
    """ValueError for a schema with keywords, types or patterns that violations() doesn't know."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict) or (odd := sorted(set(schema) - _CHECKED - _TOLD)):
        raise ValueError(f"{at}: {', '.join(odd) if isinstance(schema, dict) else 'no object'} isn't known")
    kinds = schema.get("type", [])
    if bad := [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in (*_TYPES, "null")]:
        raise ValueError(f"{at}: type {bad[0]} isn't known")
    re.compile(schema.get("pattern", ""))
    for k in ("anyOf", "allOf", "oneOf"):
        for n, x in enumerate(schema.get(k, [])):
            known(x, f"{at}.{k}[{n}]")
    for k in ("additionalProperties", "items", "not"):
        known(schema.get(k, True), f"{at}.{k}")
    for k, x in schema.get("properties", {}).items():
        known(x, f"{at}.{k}")


def _is(v: object, kind: str) -> bool:
    if kind in ("integer", "number") and isinstance(v, bool):
        return False
    if kind == "integer" and isinstance(v, float):
        return v.is_integer()
    return v is None if kind == "null" else isinstance(v, _TYPES[kind])


def _same(a: object, b: object) -> bool:
    return canonical(a) == canonical(b)


def _wrong(v: object, schema: object, at: str) -> Iterator[str]:
    """What of a schema a value violates; `at` names the value."""
    me = at or "arguments"
    if isinstance(schema, bool):
        if not schema:
            yield f"{me} isn't allowed"
        return
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(v, k) for k in kinds):
        yield f"{me} is no {' or '.join(kinds)}"
        return
    if ("enum" in schema and not any(_same(v, x) for x in schema["enum"])) or ("const" in schema and not _same(v, schema["const"])):
        yield f"{me} is none of its values"
    if isinstance(v, dict):
        fields, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        inner = lambda k: f"{at}.{k}" if at else k
        yield from (f"missing {inner(k)}" for k in schema.get("required", []) if k not in v)
        for k, x in v.items():
            if k in fields:
                yield from _wrong(x, fields[k], inner(k))
            elif more is False:
                yield f"unexpected {inner(k)}"
            else:
                yield from _wrong(x, more, inner(k))
    if isinstance(v, list):
        for k, x in enumerate(v):
            yield from _wrong(x, schema.get("items", True), f"{at}[{k}]")
    if isinstance(v, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(v, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(v) <= schema.get(high, math.inf):
            yield f"{me} has a wrong length"
        if isinstance(v, str) and not re.search(schema.get("pattern", ""), v):
            yield f"{me} doesn't match"
    if _is(v, "number") and not (schema.get("minimum", -math.inf) <= v <= schema.get("maximum", math.inf) and ("exclusiveMinimum" not in schema or v > schema["exclusiveMinimum"]) and ("exclusiveMaximum" not in schema or v < schema["exclusiveMaximum"])):
        yield f"{me} is out of range"
    fits = lambda x: not any(_wrong(v, x, at))
    for x in schema.get("allOf", []):
        yield from _wrong(v, x, at)
    if ("anyOf" in schema and not any(map(fits, schema["anyOf"]))) or ("oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1) or ("not" in schema and fits(schema["not"])):
        yield f"{me} doesn't fit"


def violations(value: object, schema: dict | None) -> list[str]:
    """What of a tool's schema its arguments violate; sorted. The keywords are those of JSON Schema named above, at any depth; arguments are an object."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(value, dict):
        return ["arguments are no object"]
    return sorted(set(_wrong(value, schema, "")))


def depths(calls: DataFrame) -> DataFrame:
    """(conv, id, depth) of distinct calls (conv, id, parent): steps to a call without a parent; null on and behind a cycle.

    Pointers are doubled, so a chain of n calls takes log2 n rounds of one join; a conversation is never in one task.
    """
    now = stored(calls.select("conv", "id", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("d")))
    longest = now.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length() + 1)):
        if now.where("ptr is not null").isEmpty():
            break
        to = now.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), F.col("ptr").alias("p2"), F.col("d").alias("d2"))
        ahead = now.where("ptr is not null").join(to, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("ptr") == F.col("i2")), "left")
        now = stored(now.where("ptr is null").unionByName(ahead.select("conv", "id", F.col("p2").alias("ptr"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))))
    return now.select("conv", "id", F.when(F.col("ptr").isNull(), F.col("d")).alias("depth"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call: (conv, turn, id, name, depth, result_turn, status, valid, errors, message).

    calls (conv, turn, id, name, arguments, parent), results (conv, turn, id, content); other columns are ignored. Calls
    meet results by (conv, id). Of calls with the same id the one of the least turn (then name, then digest of the
    arguments) is linked, the others have status `duplicate`; of results of a call the one of the least turn (then digest
    of the content) counts, and results of no call are left out. status: `no id`; `duplicate`; `cycle` on or behind a
    cycle of parents; `no parent` if the parent isn't there (its depth is 0); `no result`; `early result` if its turn
    isn't after the call's; else `ok`. depth orders calls topologically: a parent's is smaller (then turn, then id).
    message: canonical JSON of id, name, arguments, result and parent; null if the arguments aren't JSON, or hold half of
    a character pair, which no text can. Null conversations are one. A schema with unknown keywords is a ValueError.
    Empty tables give an empty result. Texts of any length are fine: ids are linked and ordered without arguments and
    contents, which join at the end, and are handled in batches of bounded size.
    """
    for name, schema in schemas.items():
        known(schema, name)
    one = F.coalesce(F.col("conv").cast("string"), F.lit("\0null")).alias("c")  # a conversation's name, never null, so joins have plain keys
    base = calls.select(one, "conv", F.col("turn").cast("long").alias("turn"), F.col("id").cast("string").alias("id"), "name", "arguments", F.col("parent").cast("string").alias("parent"))
    base = base.withColumn("digest", F.md5(F.col("arguments").cast("binary")))
    said = results.select(one, F.col("turn").cast("long").alias("t4"), F.col("id").cast("string").alias("id"), "content").where("id is not null")
    first = base.where("id is not null").groupBy("c", "id").agg(F.min(F.struct("turn", "name", "digest", "parent")).alias("f"))
    there = first.select(F.col("c").alias("c2"), F.col("id").alias("i2")).hint("shuffle_hash")
    found = first.join(there, (F.col("c") == F.col("c2")) & (F.col("f.parent") == F.col("i2")), "left")
    found = durable(found.select("c", "id", "f", (F.col("f.parent").isNotNull() & F.col("i2").isNull()).alias("lost")))
    level = depths(found.select(F.col("c").alias("conv"), "id", F.when(~F.col("lost"), F.col("f.parent")).alias("parent")))
    info = found.join(level.select(F.col("conv").alias("c"), "id", "depth").hint("shuffle_hash"), ["c", "id"])
    rank = F.struct("t4", F.md5(F.col("content").cast("binary")))
    answer = said.groupBy("c", "id").agg(F.min(F.struct("t4")).alias("r"), F.min_by("content", rank).alias("result"))
    each = base.where("id is not null").groupBy("c", "conv", "turn", "id", "name", "parent", "digest").agg(F.first("arguments").alias("arguments"), F.count("*").cast("int").alias("copies"))
    full = each.join(info.hint("shuffle_hash"), ["c", "id"], "left").join(answer, ["c", "id"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    full = full.withColumn("main", (F.col("copy") == 1) & F.struct("turn", "name", "digest", "parent").eqNullSafe(F.col("f")))
    mine = lambda c: F.when(F.col("main"), F.col(c))
    full = full.select("conv", "turn", "id", "name", "arguments", "parent", "main", "lost", mine("depth").alias("depth"), mine("r.t4").alias("result_turn"), mine("result").alias("result"), (F.col("main") & F.col("r").isNotNull()).alias("answered"))
    full = full.unionByName(base.where("id is null").drop("c", "digest"), allowMissingColumns=True)
    status = F.expr("case when id is null then 'no id' when not main then 'duplicate' when depth is null then 'cycle' when lost then 'no parent' when not answered then 'no result' when not coalesce(result_turn > turn, false) then 'early result' else 'ok' end")
    rows = full.withColumn("status", status).drop("lost", "main", "answered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "arguments"), "result"):
            valid, errors, message = [], [], []
            for i, name, args, result, parent in zip(*(b.column(c).to_pylist() for c in ("id", "name", "arguments", "result", "parent")), strict=True):
                try:
                    value = parsed(args)
                    wrong = violations(value, schemas.get(name))
                    text = canonical({"id": i, "name": name, "arguments": value, "result": result, "parent": parent})
                    text.encode()
                except (ValueError, RecursionError) as e:
                    wrong, text = [f"arguments: {type(e).__name__}"], None
                valid.append(not wrong)
                errors.append(wrong)
                message.append(text)
            cols = {c: b.column(c) for c in ("conv", "turn", "id", "name", "depth", "result_turn", "status")}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(message, pa.string())], names=[*cols, "valid", "errors", "message"])

    kind = dict(rows.dtypes)
    return mapped(rows, run, f"conv {kind['conv']}, turn long, id string, name string, depth long, result_turn long, status string, valid boolean, errors array<string>, message string")


#: Schemas of the tools in op1.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query", "limit"], "additionalProperties": False},
    "count": {"properties": {"query": {"type": "string"}, "unit": {"type": "string", "enum": ["words", "chars"]}}, "required": ["query"]},
}


def sample_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from conversations by rule, as their texts hold none: an assistant's turn is the result of a call in the turn before, each other turn is a call (without id if it has no number) that follows the one two turns before, but for those that start a new chain; some arguments violate their schema."""
    named = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("told"), F.col("text"))
    asked = named.where("not told")
    search = F.expr("coalesce(pmod(turn, 4) < 2, true)")
    args = F.when(search, F.to_json(F.struct(F.when(F.length("text") % 7 == 0, F.length("text").cast("string")).otherwise("10").cast("int").alias("limit"), F.when(F.length("text") % 5 != 0, F.col("text")).alias("query"))))
    args = args.otherwise(F.to_json(F.struct(F.when(F.length("text") % 3 == 0, F.lit("lines")).otherwise(F.lit("words")).alias("unit"), F.col("text").alias("query"))))
    calls = asked.select("conv", "turn", F.expr("'c' || turn").alias("id"), F.when(search, "search").otherwise("count").alias("name"), args.alias("arguments"), F.expr("case when turn >= 2 and coalesce(length(text) % 11 > 0, true) then 'c' || (turn - 2) end").alias("parent"))
    results = named.where("told").select("conv", "turn", F.expr("'c' || (turn - 1)").alias("id"), F.col("text").alias("content"))
    return calls, results


def op1(spark, sf_dir: str) -> DataFrame:
    out = linked(*sample_calls(table(spark, sf_dir, "conversations")), SCHEMAS)
    return out.select(F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), "name", "depth", "result_turn", "status", "valid", F.array_join("errors", "; ").alias("errors"), "message")
