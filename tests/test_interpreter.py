"""The interpreter tier against columns on the same values; recursion, callbacks below containers, tiers."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colguard import nodes as z
from colguard.api import compile
from colguard.interpreter import answers, multiple
from colguard.nodes import UnsupportedInSpark

VALUES = [
    None, True, False, 0, 1, -3, 2.5, 0.3, 1e-7, 12345678901, "", "a", "ab", " Ab ", "abc", "5", "12", "null", "a@example.com", "2020-01-01", "::1", [], [1], [1, 1, 2], ["a", "A", "b"], [1, "x"], [None, 1], [[1], [2, "y"]], {},
    {"a": 1}, {"a": "x"}, {"a": 1, "b": "q"}, {"a": None, "z": [1]}, {"b": 2}, {"1": 1, "2.5": 2}, {"t": "p", "v": 1}, {"t": "q", "v": "s"}, {"t": "r"}, {"a": {"a": 1}}, {"a": {"a": {"b": "deep"}}},
]
SCHEMAS = {
    "string": z.string().min(1).max(2).regex("^a"), "string_rewrites": z.string().trim().lower().length(2), "number": z.number().min(0).max(100).multiple_of(0.1), "int": z.number().int().gt(0), "boolean": z.boolean(), "bigint": z.bigint(),
    "null": z.null(), "undefined": z.undefined(), "void": z.void(), "any": z.any_(), "never": z.never(), "nan": z.nan(), "literal": z.literal("a", 1, None), "enum": z.enum("a", "ab"), "native_enum": z.native_enum({"A": 1, "B": "a"}),
    "email": z.string().email(), "date": z.string().format("date"), "ip": z.string().format("ip"), "includes": z.string().includes("b", 1).starts_with("a"),
    "object": z.object_({"a": z.number()}), "strict": z.object_({"a": z.number()}).strict(), "loose": z.object_({"a": z.any_()}).loose(), "catchall": z.object_({"a": z.number().optional()}).catchall(z.string().upper()),
    "nested": z.object_({"a": z.object_({"a": z.number().optional()}).nullable()}), "array": z.array(z.number()).min(1).max(2), "arrays": z.array(z.array(z.number())), "optional_members": z.array(z.number().nullable()),
    "set": z.set_(z.number()), "set_rewrites": z.set_(z.string().lower()), "tuple": z.tuple_(z.number(), z.number().optional()), "tuple_rest": z.tuple_(z.number(), rest=z.number()),
    "record": z.record(z.string(), z.number()), "record_rewrites": z.record(z.string(), z.string().upper()), "record_enum": z.record(z.enum("a", "b"), z.any_()), "record_partial": z.record(z.enum("a", "b"), z.any_(), partial=True), "record_loose": z.record(z.string().regex("^a"), z.number(), loose=True), "record_numeric": z.record(z.number(), z.number()),
    "union": z.union(z.string().min(3), z.number().max(1)), "union_checked": z.union(z.string(), z.number()).messages({"invalid_union": "neither"}), "xor": z.xor(z.number(), z.literal(1), z.string()),
    "discriminated": z.discriminated_union("t", z.object_({"t": z.literal("p"), "v": z.number()}), z.object_({"t": z.literal("q"), "v": z.string().max(0)})),
    "intersection": z.intersection(z.object_({"a": z.number()}).loose(), z.object_({"b": z.string()}).loose()), "nullable": z.string().nullable(), "default": z.object_({"a": z.number().default(4.0)}), "prefault": z.object_({"b": z.string().min(1).prefault("p")}),
    "catch": z.number().max(1).catch(0.5), "pipe": z.string().pipe(z.enum("a")), "readonly": z.string().readonly().brand("x"), "nonoptional": z.object_({"a": z.number().optional().nonoptional()}), "success": z.string().success(),
    "wrapped_sizes": z.string().nullable().check("min", value=2, inclusive=True), "wrapped_range": z.number().nullable().check("max", value=2, inclusive=True), "messages": z.object_({"a": z.string().messages({"invalid_type": "want {expected}, not {received}"})}),
}


def plain(x):
    return json.loads(x) if x is not None else None


@pytest.mark.parametrize("dialect", ["v4", "v3"])
def test_tiers_agree(spark, dialect):
    """Every schema on every value: success, issues, dirty and data are the same in both tiers."""
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i long, j string").select("i", F.parse_json("j").alias("v")).coalesce(1).cache()
    odd = []
    for name, schema in SCHEMAS.items():
        found = []
        for tier in ("columns", "interpreter"):
            done = compile(schema, df, "v", dialect=dialect, tier=tier).safe_parse(df)
            text = F.to_json(F.col("data")) if dict(done.dtypes)["data"].startswith(("struct", "array", "map", "variant")) else F.to_json(F.col("data").cast("variant"))
            found.append({r["i"]: r for r in done.select("i", "success", "dirty", text.alias("data"), F.transform("issues", lambda x: F.struct(x["code"], x["path"], x["message"])).alias("issues")).collect()})
        for i, v in enumerate(VALUES):
            a, b = (f[i] for f in found)
            same = (a["success"], a["dirty"], [tuple(x) for x in a["issues"] or []], no_nulls(plain(a["data"]))) == (b["success"], b["dirty"], [tuple(x) for x in b["issues"] or []], no_nulls(plain(b["data"])))
            odd += [] if same else [(name, v, a, b)]
    assert not odd, "\n".join(map(str, odd))


def no_nulls(x):
    """Columns hold a null where JSON leaves a field out."""
    if isinstance(x, dict):
        return {k: no_nulls(v) for k, v in x.items() if v is not None and no_nulls(v) not in ({}, [])}
    return [no_nulls(v) for v in x] if isinstance(x, list) else x


def tree(depth):
    return {"v": depth, **({"kids": [tree(depth - 1), {"v": 0}]} if depth else {})}


def test_recursive_schema_at_any_depth(spark):
    node = z.object_({"v": z.number().min(0), "kids": z.array(z.lazy(lambda: node)).optional()})
    deep_bad = tree(10)
    at = deep_bad
    for _ in range(10):
        at = at["kids"][0]
    at["v"] = -1
    rows = [json.dumps(x) for x in (tree(3), tree(10), tree(60), deep_bad, {"v": 1, "kids": {}}, {"kids": []})]
    df = spark.createDataFrame([(i, j) for i, j in enumerate(rows)], "i long, j string").select("i", F.parse_json("j").alias("v"))
    done = compile(node, df, "v")
    assert done.tier == "interpreter" and done.recursive and done.uses_python
    got = {r["i"]: r for r in done.safe_parse(df).collect()}
    assert [got[i]["success"] for i in range(6)] == [True, True, True, False, False, False]
    assert got[3]["issues"][0]["path"] == ["kids", "0"] * 10 + ["v"] and got[5]["issues"][0]["message"] == "Required"
    with pytest.raises(UnsupportedInSpark):
        compile(node, df, "v", tier="columns").validate(df)


def test_recursive_schema_on_typed_input(spark):
    """The type ends the recursion, and columns do."""
    node = z.object_({"v": z.number().max(3), "kid": z.lazy(lambda: node).optional()})
    df = spark.createDataFrame([(((1.0, (2.0, (3.0,))),),), (((1.0, (2.0, (4.0,))),),)], "v struct<n:struct<v:double,kid:struct<v:double,kid:struct<v:double>>>>").select("v.n")
    done = compile(node, df, "n")
    assert done.tier == "columns"
    assert [(r["success"], [i["path"] for i in r["issues"] or []]) for r in done.safe_parse(df).collect()] == [(True, []), (False, [["kid", "kid", "v"]])]
    with pytest.raises(UnsupportedInSpark):
        loop = z.lazy(lambda: z.union(loop, z.number()))
        compile(loop, df.select("n.v"), "v").validate(df.select("n.v"))


def test_callbacks_below_containers(spark):
    calls = []

    def even(s: pd.Series) -> pd.Series:
        calls.append(len(s))
        return s % 2 == 0

    df = spark.createDataFrame([(1, [2.0, 4.0]), (2, [2.0, 3.0]), (3, []), (4, None)], "i long, v array<double>")
    done = compile(z.array(z.number().refine_udf(even, "odd")), df, "v")
    assert done.tier == "interpreter"
    got = {r["i"]: r for r in done.safe_parse(df).collect()}
    assert [got[i]["success"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[2]["issues"][0]["path"] == ["1"] and got[2]["issues"][0]["message"] == "odd" and got[1]["data"] == [2.0, 4.0]
    twice = z.object_({"k": z.array(z.number().transform_udf(lambda s: s * 2).refine_udf(lambda s: s < 10))})
    df = spark.createDataFrame([('{"k":[1,2]}',), ('{"k":[1,7]}',)], "j string").select(F.parse_json("j").alias("v"))
    assert [(r["success"], r["d"]) for r in compile(twice, df, "v").safe_parse(df).select("success", F.to_json("data").alias("d")).collect()] == [(True, '{"k":[2,4]}'), (False, None)]


def test_one_call_a_batch_and_round():
    calls = []

    def known(s):
        calls.append(sorted(s.tolist()))
        return s > 1

    schema = z.array(z.number().refine_udf(known))
    got = list(answers(schema, "v4", False, False, {}, [json.dumps([1, 2, 3]), json.dumps([2, 3]), json.dumps([])]))
    assert calls == [[1, 2, 3]] and [g[0] for g in got] == [False, True, True]


def test_refused_in_the_interpreter(spark):
    df = spark.createDataFrame([("1",)], "j string").select(F.parse_json("j").alias("v"))
    for schema in (z.number().refine(lambda v: v > 1), z.date(), z.string().transform(F.upper), z.string().overwrite(F.upper)):
        with pytest.raises(UnsupportedInSpark):
            compile(schema, df, "v", tier="interpreter").validate(df)


@pytest.mark.parametrize(("x", "n", "want"), [(0.3, 0.1, True), (0.30000000000000004, 0.1, False), (1.1, 0.01, True), (0.1234567890123, 0.0000000000001, True), (0.12345678901234567, 1e-17, True), (0.12345678901234567, 1e-16, False), (7, 0, False), (1e20, 0.1, True), (-0.6, 0.2, True), (3e-7, 1e-7, True), (2.5e-7, 1e-7, True), (1e-7, 0.1, True), (5, 2, False), (4503599627370497.5, 0.5, True)])
def test_multiples(spark, x, n, want):
    df = spark.createDataFrame([(float(x),)], "v double")
    assert compile(z.number().multiple_of(n), df, "v").safe_parse(df).head()["success"] is want
    assert multiple(x, n) is want
