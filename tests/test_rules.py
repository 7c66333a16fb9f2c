"""Plans and single rules: streaming callbacks, messages, purity, wrappers, one lowering, patterns."""

import re
import time

import pytest
from pyspark.sql import functions as F

from colguard import nodes as z
from colguard import regexes
from colguard.api import absence_stable, compile, static_pure
from colguard.interpreter import _compiled
from colguard.nodes import UnsupportedInSpark, is_recursive


def nest(depth):
    return z.string().trim().min(1) if not depth else z.array(nest(depth - 1))


def test_building_grows_slowly_with_depth(spark):
    """Six levels of arrays take little more than one: a member is lowered once for each question."""
    took = []
    for depth in (1, 6):
        df = spark.createDataFrame([], "v " + "array<" * depth + "string" + ">" * depth)
        began = time.time()
        node = compile(nest(depth), df, "v").node()
        node.issues()
        took.append(time.time() - began)
    assert took[1] < 1.0
    value = " a "
    for _ in range(6):
        value = [value]
    df = spark.createDataFrame([(value,)], "v " + "array<" * 6 + "string" + ">" * 6)
    row = compile(nest(6), df, "v").safe_parse(df).head()
    assert row["success"] and row["dirty"] and row["data"] == [[[[[["a"]]]]]]


def test_wrapper_checks_need_a_measure(spark):
    df = spark.createDataFrame([(True,)], "v boolean")
    with pytest.raises(UnsupportedInSpark):
        compile(z.boolean().optional().min(1), df, "v").safe_parse(df)
    with pytest.raises(UnsupportedInSpark):
        compile(z.string().regex("a", flags="y"), df, "v").validate(df)


def test_purity():
    tree = z.object_({"kids": z.array(z.lazy(lambda: tree))})
    assert static_pure(tree) and is_recursive(tree) and not is_recursive(z.lazy(z.string))
    assert static_pure(z.object_({"a": z.string().min(1).optional()})) and static_pure(z.record(z.string(), z.number()))
    for schema in (z.string().trim(), z.tuple_(z.string()), z.array(z.string().optional()), z.string().default("x"), z.number(coerce=True), z.object_({}).readonly(), z.string().transform(F.upper)):
        assert not static_pure(schema)
    assert absence_stable(z.string().optional().nullable()) and absence_stable(z.union(z.any_(), z.void()))
    assert not absence_stable(z.union(z.any_(), z.string())) and not absence_stable(z.string().default("x"))


def test_v3_pure_and_validate(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert compile(z.string(), df, "v", dialect="v3").pure and not compile(z.string().upper(), df, "v", dialect="v3").pure
    assert [r["data"] for r in compile(z.string().upper(), df, "v", dialect="v3").validate(df).collect()] == ["A", "B"]
    with pytest.raises(Exception, match=r"\[too_small\] <root>: String must contain at least 2"):
        compile(z.string().min(2), df, "v", dialect="v3").validate(df).collect()


def test_messages_go_from_default_to_explicit(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, n double")
    own = z.object_({"s": z.string().min(2, "explicit").min(3).messages({"too_small": lambda p, said: F.concat(said, F.lit("!"), p["minimum"])}), "n": z.number().min(2)})
    row = compile(own, df, messages={"too_small": "at least {minimum} of {type}"}).safe_parse(df).head()
    assert [i["message"] for i in row["issues"]] == ["explicit", "at least 3 of string!3", "at least 2 of number"]


@pytest.mark.parametrize(("pattern", "flags", "good", "bad"), [
    (r"^\s$", "", [" ", "﻿", " "], ["​", "a"]), (r"^[^]$", "", ["\n", "x"], ["", "xy"]), (r"[]", "", [], ["", "a"]), (r"^[[&&a]+$", "", ["[&a"], ["b"]), (r"^\u{1F600}$", "u", ["\U0001f600"], ["u"]),
    (r"^.$", "", ["\u0085", "a"], [" ", "\n"]), (r"^a|b$", "m", ["x\na", "b\ny"], ["xa", "by"]), (r"\$$", "", ["5$"], ["$5", "5$\n"]), (r"^[$^.]+$", "", ["$.^"], ["a"]), (r"a/b\/c$", "i", ["A/B/C"], ["abc"]),
])
def test_javascript_patterns(spark, pattern, flags, good, bad):
    """Both in Java (columns) and in Python (interpreter)."""
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    for row in compile(z.string().regex(pattern, flags=flags), df, "v").safe_parse(df).collect():
        assert row["success"] == row["want"], ascii(row["v"])
        assert bool(_compiled(regexes.java(pattern, flags)).search(row["v"])) == row["want"], ascii(row["v"])


def test_patterns_have_plain_text():
    for name, p in regexes.FORMATS.items():
        assert p.isascii() and re.search(r"\\z", p), name


def test_streaming_with_the_interpreter(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "i long, v array<double>")
    df.write.parquet(str(tmp_path / "in"))
    schema = z.array(z.number().refine_udf(lambda s: s < 3))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = compile(schema, stream, "v").safe_parse(stream).select("i", "success")
    done.writeStream.format("memory").queryName("members").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("members").collect())) == [(1, True), (2, False)]


def test_verdicts_are_made_once(spark):
    """safe_parse has ok as a column of its own below the others."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("value", "event_type")
    schema = z.object_({"value": z.number().min(5).max(7), "event_type": z.string().default("x")})
    plan = compile(schema, df).safe_parse(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") >= 2 and plan.count("<= 7.0") <= 3


URLS = ["https://example.com/a?b#c", "mailto:a@b.c", "http:example.com", "HTTP://EXAMPLE.com:80", "foo:bar baz", "http://[::1]:3000/", "file:///x", "file:x", "http://a_b.c", "http://1.2.3", "javascript:alert(1)", "http://user:pa@ss@h/", " http://x.y ", "http://ex\tample.com", "http:\\\\x.y\\z", "http://0x7f.1/", "foo://", "foo://h:1/", "http://xn--a.b/%20", "http://é.fr", "ws://h?q", "http://h:/", "http://1.2.3.com"]
NO_URLS = ["foo bar", "example.com", "http://", "http:///", "http://a b.c", "http://h:65536", "http://h:x", "http://1.2.3.256", "http://[::1", "https://?q", "//x.y", "http://a<b", "1http://x", "http://%", "http://a%20b", "", ":", "foo://a b", "foo://h:99999/", "http://1.2.3.4.5", "http://[1.2.3.4]", "http://a^b"]


def test_urls(spark):
    df = spark.createDataFrame([(v, True) for v in URLS] + [(v, False) for v in NO_URLS], "v string, want boolean")
    wrong = [ascii(r["v"]) for r in compile(z.string().url(), df, "v").safe_parse(df).collect() if r["success"] != r["want"]]
    wrong += [ascii(r["v"]) for r in df.collect() if bool(_compiled(regexes.url()).search(_compiled(regexes.URL_ENDS).sub("", r["v"]))) != r["want"]]
    assert not wrong


def test_options_need_a_tag(spark):
    df = spark.createDataFrame([(("a",),)], "v struct<t:string>")
    for option in (z.string(), z.object_({"t": z.string()}), z.xor(z.object_({"t": z.literal("a")}), z.object_({"t": z.literal("b")}))):
        with pytest.raises(UnsupportedInSpark):
            compile(z.discriminated_union("t", option), df, "v").validate(df)
    with pytest.raises(ValueError, match="claimed twice"):
        compile(z.discriminated_union("t", z.object_({"t": z.literal("a")}), z.object_({"t": z.enum("a", "b")})), df, "v").validate(df)


def test_a_callback_that_fails_fails_the_job(spark):
    def bad(s):
        raise KeyError("callback")

    df = spark.createDataFrame([(["a"],)], "v array<string>")
    with pytest.raises(Exception, match="callback"):
        compile(z.array(z.string().refine_udf(bad)), df, "v").safe_parse(df).collect()


def test_code_is_sql(spark):
    """The text of ok gives the same verdicts when Spark reads it as SQL."""
    df = spark.createDataFrame([("abc", 1.0), ("a", 5.0), (None, 2.0)], "s string, n double")
    done = compile(z.object_({"s": z.string().min(2), "n": z.number().max(3)}), df)
    text = done.code(df)
    assert set(text) >= {"value", "ok", "issues"}
    assert [r[0] for r in df.selectExpr(f"coalesce({text['ok']}, false)").collect()] == [r["success"] for r in done.safe_parse(df).collect()] == [True, False, False]
