"""Behaviour fixtures, plans, both dialects, streaming."""

import pytest
from pyspark.sql import functions as F

from colguard import nodes as z
from colguard.api import check_count, compile
from colguard.nodes import UnsupportedInSpark

ACCOUNT = z.object_({
    "id": z.number().int(), "firstName": z.string().max(64), "email": z.string().email(), "role": z.enum("admin", "member", "viewer"), "balance": z.number(),
    "createdAt": z.string().format("datetime"), "tags": z.array(z.string()).max(8), "address": z.object_({"city": z.string(), "zip": z.string()}), "active": z.boolean(),
})
GOOD = (1.0, "Ann", "a@example.com", "admin", 5.0, "2024-01-02T03:04:05Z", ["x"], ("Rome", "1"), True)
TYPE = "id double, firstName string, email string, role string, balance double, createdAt string, tags array<string>, address struct<city:string,zip:string>, active boolean"


def accounts(spark, **changes):
    names = [c.split(" ")[0] for c in TYPE.split(", ")]
    return spark.createDataFrame([tuple(changes.get(n, v) for n, v in zip(names, GOOD, strict=True))], TYPE)


def verdict(spark, dialect="v4", **changes):
    df = accounts(spark, **changes)
    return compile(ACCOUNT, df, dialect=dialect).safe_parse(df).head()


def test_account(spark):
    row = verdict(spark)
    assert row["success"] and not row["dirty"] and row["issues"] is None and row["data"]["address"]["city"] == "Rome"
    for bad in ({"id": 1.5}, {"firstName": "x" * 65}, {"email": "not-an-email"}, {"email": "user@example"}, {"email": ".a@example.com"}, {"createdAt": "2024-01-02"}, {"createdAt": "2024-01-02T03:04:05+02:00"}, {"role": "root"}, {"tags": list("123456789")}, {"balance": float("nan")}, {"createdAt": None}):
        row = verdict(spark, **bad)
        assert not row["success"] and row["issues"][0]["path"][0] == next(iter(bad)), bad


@pytest.mark.parametrize(("change", "v4", "v3"), [({"firstName": "\U0001f600" * 64}, True, False), ({"firstName": "\U0001f600" * 32}, True, True), ({"balance": float("inf")}, False, True), ({"id": 2.0**53 + 2}, False, True), ({"id": float("inf")}, False, False)])
def test_dialects(spark, change, v4, v3):
    assert verdict(spark, "v4", **change)["success"] is v4
    assert verdict(spark, "v3", **change)["success"] is v3


def one(spark, schema, value, dtype, **options):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return compile(schema, df, "v", **options).safe_parse(df).head()


def test_issues(spark):
    row = one(spark, z.string().min(5).email(), "ab", "string")
    assert [(i["code"], i["message"]) for i in row["issues"]] == [("too_small", "String must contain at least 5 character(s)"), ("invalid_string", "Invalid email")]
    row = one(spark, z.array(z.object_({"n": z.number().max(1)})), [(1.0,), (2.0,)], "array<struct<n:double>>")
    assert row["issues"][0]["path"] == ["1", "n"] and row["issues"][0]["params"]["maximum"] == "1"
    row = one(spark, z.set_(z.number().max(1)), [1.0, 3.0], "array<double>")
    assert row["issues"][0]["path"] == ["1"]
    row = one(spark, z.record(z.string(), z.number()), {"k": None}, "map<string,double>")
    assert row["issues"][0]["path"] == ["k"] and row["issues"][0]["message"] == "Required"


@pytest.mark.parametrize(("schema", "good", "bad"), [
    (z.string().format("ip"), ["1.2.3.4", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4"], ["1.2.3.256", "1:2", "::1\n", ":::"]),
    (z.string().format("cidr"), ["1.2.3.4/32", "::/0"], ["1.2.3.4/33", "::/129", "1.2.3.4"]),
    (z.string().format("duration"), ["P1Y", "P1Y2M3DT4H5M6S", "-P1.5D", "PT1.5S"], ["P", "PT", "P1S", "P1.5Y2M"]),
    (z.string().format("jwt"), ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.e30.x"], ["a.b.c", "eyJhbGciOiJIUzI1NiJ9.e30.x", "x"]),
    (z.string().format("url"), ["https://example.com/a?b#c", "mailto:a@b.c"], ["foo bar", "example.com"]),
    (z.string().format("emoji"), ["\U0001f600", "\U0001f44d\U0001f3fd"], ["a", "", "\U0001f600a"]),
    (z.string().format("time", precision=0), ["10:11:12"], ["10:11:12.1", "24:00:00"]),
    (z.string().format("datetime", local=True, precision=3), ["2020-01-01T00:00:00.123", "2020-01-01T00:00:00.123Z"], ["2020-01-01T00:00:00Z", "2021-02-29T00:00:00.123"]),
    (z.string().regex("^a$"), ["a"], ["a\n", "ba"]), (z.string().trim().length(1), ["﻿ a  "], ["  "]),
    (z.string().includes("b", 2), ["aab"], ["ba"]),
])
def test_formats(spark, schema, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    for row in compile(schema, df, "v").safe_parse(df).collect():
        assert row["success"] == row["want"], row["v"]


def test_multiple_of(spark):
    assert one(spark, z.number().multiple_of(0.1), 0.3, "double")["success"]
    assert not one(spark, z.number().multiple_of(0.1), 0.35, "double")["success"]


def test_lazy_tree(spark):
    tree = z.object_({"v": z.number(), "kids": z.array(z.lazy(lambda: tree)).optional()})
    df = spark.createDataFrame([('{"v":1,"kids":[{"v":2},{"v":3,"kids":[{"v":4}]}]}', True), ('{"v":1,"kids":[{"v":"x"}]}', False)], "j string, want boolean").select(F.parse_json("j").alias("v"), "want")
    for row in compile(tree, df, "v").safe_parse(df).select("success", "want").collect():
        assert row["success"] == row["want"]


def test_pure_schema_leaves_the_plan_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = z.object_({"value": z.number().min(5), "event_type": z.enum("click", "view")})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = compile(schema, df).validate(df).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(value,5.0)" in plan and "In(event_type" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert compile(schema.strip(), df.select("value", "event_type")).pure
    assert not compile(z.object_({"value": z.number().default(1.0)}), df.select("value")).pure


def test_parse_fails_with_issues(spark):
    df = spark.createDataFrame([(1.0,), (9.0,)], "v double")
    with pytest.raises(Exception, match="too_big"):
        compile(z.number().max(5), df, "v").parse(df).collect()


def test_split_report_count(spark):
    df = spark.createDataFrame([(1.0,), (9.0,)], "v double")
    done = compile(z.number().max(5), df, "v")
    good, bad = done.split(df)
    assert (good.count(), bad.count()) == (1, 1)
    assert [tuple(r) for r in done.report(df).collect()] == [("too_big", "", 1)]
    assert check_count(df, 3).head()["ok"] is False


def test_compile_errors(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for schema in (z.symbol(), z.string().format("nope")):
        with pytest.raises(UnsupportedInSpark):
            compile(schema, df, "v").validate(df)
    with pytest.raises(TypeError):
        compile(z.string(), df, "v", colour=1)
    assert compile(z.string().refine_udf(lambda s: s == "a"), df, "v").uses_python
    assert "length" in compile(z.string().min(1), df, "v").explain()["ok"]


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(str(tmp_path / "in"))
    schema = z.object_({"event_type": z.enum("click", "view"), "value": z.number().max(100)})
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = compile(schema, stream).safe_parse(stream).select("event_id", "success")
    done.writeStream.format("memory").queryName("parsed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    want = compile(schema, df).safe_parse(df).select("event_id", "success")
    assert sorted(spark.table("parsed").collect()) == sorted(want.collect())


def test_super_refine_and_catch(spark):
    from colguard.issues import issue

    s = z.string().super_refine(lambda v: F.when(v == "bad", F.array(issue("custom", [], "no"))).otherwise(F.expr("cast(array() as array<struct<code:string,path:array<string>,message:string,params:map<string,string>>>)")))
    assert one(spark, s, "bad", "string")["issues"][0]["message"] == "no" and one(spark, s, "ok", "string")["success"]
    assert one(spark, s.catch("x"), "bad", "string")["data"] == "x"
