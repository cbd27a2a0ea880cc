import json

import pytest

from tidequery.llm import tool_calls as tc


def test_canonical_and_violations():
    assert tc.canonical(tc.parsed('{"b": 1.0, "a": [true, null, "é\\u0001"], "c": {"z": 0.5, "y": 1e3}}')) == '{"a":[true,null,"é\\u0001"],"b":1,"c":{"y":1000,"z":0.5}}'
    for bad in ('{"a":1,"a":2}', "NaN", "[1,]", "", None):
        with pytest.raises(ValueError):
            tc.parsed(bad)
    s = tc.SCHEMAS["search"]
    assert tc.violations({"query": "x", "limit": 3}, s) == []
    assert tc.violations({"limit": True, "z": 1}, s) == ["limit is no integer", "missing query", "unexpected z"]
    assert tc.violations({"query": "x", "unit": "y"}, tc.SCHEMAS["count"]) == ["unit is none of its values"]
    deep = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": ["integer", "null"], "minimum": 2}, "maxItems": 3}, "b": {"anyOf": [{"type": "string", "pattern": "^x", "maxLength": 2}, {"const": 1}]}}, "additionalProperties": {"type": "object", "required": ["k"]}}
    tc.known(deep)
    assert tc.violations({"a": [2, None, 3.0], "b": "xy", "z": {"k": 1}}, deep) == []
    assert tc.violations({"a": [1, "s", True, 4.5], "b": True, "z": {}}, deep) == ["a has a wrong length", "a[0] is out of range", "a[1] is no integer or null", "a[2] is no integer or null", "a[3] is no integer or null", "b doesn't fit", "missing z.k"]
    for bad in ({"type": "int"}, {"properties": {"a": {"format": "x"}}}, {"items": 3}):
        with pytest.raises(ValueError):
            tc.known(bad)
    assert tc.violations([], s) == ["arguments are no object"] and tc.violations({}, None) == ["unknown tool"]


def brute(calls, results):
    first = {}
    for c in sorted(calls, key=lambda c: (c[1] is not None, c[1] or 0, c[3], c[4] or "")):
        if c[2] is not None:
            first.setdefault((c[0], c[2]), c)
    res = {}
    for r in sorted(results, key=lambda r: (r[1], r[3] or "")):
        if r[2] is not None:
            res.setdefault((r[0], r[2]), r)

    def depth(k):
        d, seen = 0, set()
        while k in first and first[k][5] is not None and (k[0], first[k][5]) in first:
            if k in seen:
                return None
            seen.add(k)
            d, k = d + 1, (k[0], first[k][5])
        return d

    out, used = [], set()
    for c in calls:
        k = (c[0], c[2])
        main = c[2] is not None and first[k] == c and k not in used
        used |= {k} if main else set()
        d, r = (depth(k), res.get(k)) if main else (None, None)
        lost = main and c[5] is not None and (c[0], c[5]) not in first
        s = "no id" if c[2] is None else "duplicate" if not main else "cycle" if d is None else "no parent" if lost else "no result" if r is None else "early result" if not (c[1] is not None and r[1] > c[1]) else "ok"
        out.append((c[0], c[1], c[2], c[3], d, r[1] if r else None, s))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    a = '{"query": "q", "limit": 1}'
    calls = [(1, t, f"c{t}", "search", a, f"c{t - 1}" if t else None) for t in range(70)]
    calls += [(2, 0, "x", "search", a, "y"), (2, 1, "y", "count", "{", "x"), (2, 2, "z", "count", '{"query":"é"}', "y"), (2, 3, "w", "none", a, "gone"), (2, 3, "w", "none", a, "gone"), (2, 9, "w", "search", a, None)]
    calls += [(None, 5, "n", "search", a, None), (None, 6, "m", "search", None, "n"), (6, 1, "half", "search", '{"query":"\\ud800","limit":1}', None), (6, 2, "long", "search", '{"query":"%s","limit":1}' % ("x" * 3_000_000), None), (3, 1, None, "search", a, None), (4, None, "t", "search", a, None), (5, 8, "early", "search", a, None)]
    results = [(1, t, f"c{t - 1}", "r" * t) for t in range(1, 60, 2)] + [(2, 7, "w", "late"), (2, 4, "w", "soon"), (9, 9, "nobody", "x"), (None, 7, "n", None), (5, 3, "early", "e"), (4, 1, "t", "v"), (1, 2, None, "q")]
    c = spark.createDataFrame([(*x, 1, "z", 2) for x in calls], "conv long, turn long, id string, name string, arguments string, parent string, k int, digest string, result int")
    r = spark.createDataFrame(results, "conv long, turn long, id string, content string")
    got = tc.linked(c, r, tc.SCHEMAS).collect()
    assert sorted([(x.conv, x.turn, x.id, x.name, x.depth, x.result_turn, x.status) for x in got], key=repr) == brute(calls, results)
    by = {(x.conv, x.id, x.turn): x for x in got}
    assert by[1, "c5", 5].valid and json.loads(by[1, "c4", 4].message) == {"id": "c4", "name": "search", "arguments": {"query": "q", "limit": 1}, "result": "r" * 5, "parent": "c3"}
    assert by[2, "y", 1].message is None and not by[2, "y", 1].valid and by[2, "w", 3].errors == ["unknown tool"]
    assert by[6, "half", 1].errors == ["arguments: UnicodeEncodeError"] and by[6, "half", 1].message is None and by[6, "long", 2].valid
    assert tc.linked(c.limit(0), r, tc.SCHEMAS).count() == 0 and tc.linked(c, r.limit(0), tc.SCHEMAS).count() == len(calls)


def test_the_query_orders_deep_chains_and_reads_all_turns(spark):
    rows = [(1, t, ["user", "system", None][t % 3] if t % 2 == 0 else "assistant", "text" + "x" * (t % 3)) for t in range(80)] + [(2, None, "user", "t"), (None, 0, "user", None), (2, 4, "tool", "")]
    calls, results = tc.sample_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = tc.linked(calls, results, tc.SCHEMAS).collect()
    assert len(got) == 43 and max(x.depth for x in got if x.depth is not None) > 8
    assert {x.status for x in got} >= {"ok", "no id", "no result"}
