"""The driver's queries over the synthetic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard import nodes as z
from colguard.api import check_count, compile
from colguard.issues import issue, none

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _valid(name: str, source: str, schema: z.Schema, keep: list[str], sql: str, **more: Column) -> None:
    """Rows of a table (with columns made by expressions) that pass a schema over the row."""

    def run(spark, sf):
        df = table(spark, sf, source).withColumns({k: c() for k, c in more.items()})
        return compile(schema, df).validate(df).select(*keep)

    QUERIES[name], SQL[name] = run, sql


def _parsed(name: str, source: str, schema: z.Schema, made: Callable[[], Column], key: list[str], out: dict[str, Callable[[], Column]], sql: str, **options) -> None:
    """safe_parse of one made column `v`; columns of the result as told."""

    def run(spark, sf):
        df = table(spark, sf, source).select(*key, made().alias("v"))
        return compile(schema, df, "v", **options).safe_parse(df).select(*key, *[c().alias(k) for k, c in out.items()])

    QUERIES[name], SQL[name] = run, sql


C, E = F.col, F.expr  # only called when a query runs
OK = {"success": lambda: C("success")}
N_ISSUES = {"n_issues": lambda: F.coalesce(F.size("issues"), F.lit(0)).cast("long")}
CODES = {"codes": lambda: F.coalesce(F.array_join(F.transform("issues", lambda i: i["code"]), ","), F.lit(""))}
PATHS = {"paths": lambda: F.coalesce(F.array_join(F.transform("issues", lambda i: F.array_join(i["path"], ".")), ","), F.lit(""))}
MESSAGES = {"messages": lambda: F.coalesce(F.array_join(F.transform("issues", lambda i: i["message"]), "; "), F.lit(""))}
DATA = {"data": lambda: C("data")}
DIRTY = {"dirty": lambda: C("dirty")}

_s, _n = z.string, z.number
_valid("validate_number_range", "events", z.object_({"value": _n().min(5).max(400).finite()}), ["event_id", "value"], "SELECT event_id, value FROM events WHERE value >= 5 AND value <= 400")
_valid("validate_gt_lt", "events", z.object_({"value": _n().gt(5).lt(100)}), ["event_id"], "SELECT event_id FROM events WHERE value > 5 AND value < 100")
_valid("validate_enum_len", "events", z.object_({"event_type": z.enum("click", "view", "purchase").pipe(_s().length(5))}), ["event_id", "event_type"], "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
_valid("validate_int", "lineitem", z.object_({"l_quantity": _n().int(), "half": _n().int()}), ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = round(l_quantity) AND l_quantity / 2 = round(l_quantity / 2)", half=lambda: C("l_quantity") / 2)
_valid("validate_multiple_of", "events", z.object_({"value": _n().multiple_of(0.1)}), ["event_id", "value"], "SELECT event_id, value FROM events WHERE CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18)) % CAST('0.1' AS DECIMAL(38,18)) = 0")
_valid("validate_bigint", "events", z.object_({"user_id": z.bigint().min(10).max(500).multiple_of(3)}), ["event_id", "user_id"], "SELECT event_id, user_id FROM events WHERE user_id BETWEEN 10 AND 500 AND user_id % 3 = 0")
_valid("validate_date_range", "orders", z.object_({"o_orderdate": z.date().min(datetime(1995, 1, 1)).max(datetime(1996, 12, 31))}), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
_valid("validate_regex", "customer", z.object_({"c_name": _s().regex("^Customer#[0-9]{8}[02468]$")}), ["c_custkey"], "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]{8}[02468]$')")
_valid("validate_substrings", "customer", z.object_({"c_mktsegment": _s().includes("U").starts_with("A"), "c_name": _s().ends_with("5").includes("0", 12)}), ["c_custkey"], "SELECT c_custkey FROM customer WHERE contains(c_mktsegment, 'U') AND starts_with(c_mktsegment, 'A') AND ends_with(c_name, '5') AND contains(substr(c_name, 13), '0')")
_valid("validate_literal_union", "orders", z.object_({"o_orderstatus": z.union(z.literal("F"), z.literal("O"))}), ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
_valid("validate_nullable_optional", "events", z.object_({"a": _n().optional().nullable(), "b": _s().optional(), "event_type": _s().min(5)}), ["event_id"], "SELECT event_id FROM events WHERE length(event_type) >= 5", a=lambda: E("nullif(value, value)"), b=lambda: E("CASE WHEN event_id % 2 = 0 THEN event_type END"))
_valid("validate_refine", "lineitem", z.object_({"l_quantity": _n().refine(lambda v: v % 2 == 1), "l_discount": _n().refine(lambda v: v < 0.05, when=lambda v: v > 0.02)}), ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity % 2 = 1 AND (l_discount <= 0.02 OR l_discount < 0.05)")
_valid("validate_never_any", "nation", z.object_({"n_name": z.any_(), "gone": z.never().optional()}), ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0", gone=lambda: E("CASE WHEN n_nationkey % 2 = 1 THEN 'x' END"))
_valid("validate_boolean_undefined_null", "nation", z.object_({"flag": z.boolean(), "none": z.undefined()}), ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey < 20", flag=lambda: E("CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey > 5 END"), none=lambda: E("CASE WHEN n_nationkey >= 20 THEN 1 END"))


def _format(name: str, made: str, sql_value: str, pattern: str, key="c_custkey", source="customer", **args):
    _parsed(f"format_{name}", source, _s().format(name, **args), lambda: E(made), [key], OK, f"SELECT {key}, regexp_full_match({sql_value}, '{pattern}') AS success FROM {source}")


_U = "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), CASE WHEN c_custkey % 3 = 0 THEN '_' ELSE '-' END, substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12))"
_format("uuid", _U, _U, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_format("cuid", "concat(CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'd' END, substr(md5(c_name), 1, 5 + cast(c_custkey % 6 AS int)))", "concat(CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'd' END, substr(md5(c_name), 1, 5 + CAST(c_custkey % 6 AS int)))", "[cC][^\\s-]{8,}")
_format("cuid2", "concat(md5(c_name), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Z' END)", "concat(md5(c_name), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Z' END)", "[0-9a-z]+")
_format("ulid", "substr(upper(md5(c_name)), 1, 25 + cast(c_custkey % 3 AS int))", "substr(upper(md5(c_name)), 1, 25 + CAST(c_custkey % 3 AS int))", "[0-9A-HJKMNP-TV-Z]{26}")
_format("nanoid", "substr(concat('_-', md5(c_name)), 1, 20 + cast(c_custkey % 3 AS int))", "substr(concat('_-', md5(c_name)), 1, 20 + CAST(c_custkey % 3 AS int))", "[a-zA-Z0-9_-]{21}")
_format("base64", "substr('QUJDREVGRw==', 1 + cast(c_custkey % 5 AS int), 12)", "substr('QUJDREVGRw==', 1 + CAST(c_custkey % 5 AS int), 12)", "([0-9a-zA-Z+/]{4})*(([0-9a-zA-Z+/]{2}==)|([0-9a-zA-Z+/]{3}=))?")
_format("base64url", "substr('QU-DRE_GRw==', 1 + cast(c_custkey % 5 AS int), 12)", "substr('QU-DRE_GRw==', 1 + CAST(c_custkey % 5 AS int), 12)", "([0-9a-zA-Z_-]{4})*(([0-9a-zA-Z_-]{2}(==)?)|([0-9a-zA-Z_-]{3}(=)?))?")
_IP = "concat(c_custkey % 300, '.', c_custkey % 256, '.1.', c_custkey % 10)"
_V4 = "((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_format("ip", _IP, _IP, _V4, version="v4")
_CIDR = f"concat({_IP}, '/', c_custkey % 40)"
_format("cidr", _CIDR, _CIDR, _V4 + "/(3[0-2]|[12]?[0-9])", version="v4")
_format("date", "concat(1990 + o_orderkey % 20, '-0', 1 + o_orderkey % 9, '-', 10 + o_orderkey % 25)", "concat(1990 + o_orderkey % 20, '-0', 1 + o_orderkey % 9, '-', 10 + o_orderkey % 25)", "[0-9]{4}-((0[13578])-([12][0-9]|3[01])|(0[469])-([12][0-9]|30)|02-(1[0-9]|2[0-8]))|(1992|1996|2000|2004|2008)-02-29", "o_orderkey", "orders")
_TIME = "concat(10 + o_orderkey % 20, ':30:', 10 + o_orderkey % 60, CASE WHEN o_orderkey % 2 = 0 THEN '.123' ELSE '' END)"
_format("time", _TIME, _TIME, "([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?", "o_orderkey", "orders")
_DT = "concat('2020-05-1', o_orderkey % 10, 'T10:11:12', CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 3 = 1 THEN '+02:00' ELSE '' END)"
_format("datetime", _DT, _DT, "2020-05-1[0-9]T10:11:12(Z|[+-][0-9]{2}:?[0-9]{2})", "o_orderkey", "orders", offset=True)
_format("duration", "concat('P', c_custkey % 10, CASE WHEN c_custkey % 3 = 0 THEN 'D' WHEN c_custkey % 3 = 1 THEN 'X' ELSE 'Y' END)", "concat('P', c_custkey % 10, CASE WHEN c_custkey % 3 = 0 THEN 'D' WHEN c_custkey % 3 = 1 THEN 'X' ELSE 'Y' END)", "P[0-9][DY]")
_MAIL = "concat(CASE WHEN c_custkey % 5 = 0 THEN '.' ELSE '' END, 'a', c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '..b' ELSE '' END, '@ex', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.com' END)"
_format("email", _MAIL, f"CASE WHEN {_MAIL} LIKE '.%' OR {_MAIL} LIKE '%..%' THEN '' ELSE {_MAIL} END", "[A-Za-z0-9_+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*[.])+[A-Za-z]{2,}")

_parsed("string_utf16_length", "documents", _s().max(1500), lambda: C("text"), ["doc_id"], OK | CODES, "SELECT doc_id, u <= 1500 AS success, CASE WHEN u <= 1500 THEN '' ELSE 'too_big' END AS codes FROM (SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS u FROM documents)", dialect="v3")
_parsed("string_length_exact", "customer", _s().length(18), lambda: E("substr(concat(c_name, 'xx'), 1, 16 + cast(c_custkey % 5 AS int))"), ["c_custkey"], OK | CODES | MESSAGES, "SELECT c_custkey, n = 18 AS success, CASE WHEN n > 18 THEN 'too_big' WHEN n < 18 THEN 'too_small' ELSE '' END AS codes, CASE WHEN n = 18 THEN '' ELSE 'String must contain exactly 18 character(s)' END AS messages FROM (SELECT c_custkey, 16 + c_custkey % 5 AS n FROM customer)")
_TRIM = "CASE WHEN turn % 2 = 0 THEN concat('  ', text, chr(10)) ELSE lower(trim(text)) END"
_parsed("trim_lower", "conversations", _s().trim().lower(), lambda: E(_TRIM), ["conv_id", "turn"], DATA | DIRTY, f"SELECT conv_id, turn, d AS data, v <> d AS dirty FROM (SELECT *, lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')) AS d FROM (SELECT *, {_TRIM} AS v FROM conversations))")
_UP = "CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END"
_parsed("upper_overwrite", "events", _s().upper().overwrite(lambda v: F.regexp_replace(v, "K$", "Q")), lambda: E(_UP), ["event_id"], DATA | DIRTY, f"SELECT event_id, d AS data, v <> d AS dirty FROM (SELECT event_id, {_UP} AS v, regexp_replace(upper(event_type), 'K$', 'Q') AS d FROM events)")
_parsed("default_inject_dirty", "events", _s().default("other"), lambda: E("nullif(event_type, 'click')"), ["event_id"], DATA | DIRTY, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'other' ELSE event_type END AS data, event_type = 'click' AS dirty FROM events")
_parsed("default_v3_validated", "events", _s().min(6).default("other"), lambda: E("nullif(event_type, 'click')"), ["event_id"], OK, "SELECT event_id, event_type <> 'click' AND length(event_type) >= 6 AS success FROM events", dialect="v3")
_parsed("prefault_transform", "events", _s().upper().prefault("other"), lambda: E("nullif(event_type, 'view')"), ["event_id"], DATA, "SELECT event_id, CASE WHEN event_type = 'view' THEN 'OTHER' ELSE upper(event_type) END AS data FROM events")
_parsed("catch_value", "events", _n().max(100).catch(-1.0), lambda: C("value"), ["event_id"], OK | DATA | DIRTY, "SELECT event_id, true AS success, CASE WHEN value <= 100 THEN value ELSE -1.0 END AS data, value > 100 AS dirty FROM events")
_parsed("transform_pipe", "events", _s().transform(F.length, "int").pipe(_n().min(6)), lambda: C("event_type"), ["event_id"], OK | DATA, "SELECT event_id, length(event_type) >= 6 AS success, CASE WHEN length(event_type) >= 6 THEN length(event_type) END::INTEGER AS data FROM events")
_parsed("preprocess", "events", z.preprocess(lambda v: F.upper(v), z.enum("CLICK", "VIEW")), lambda: C("event_type"), ["event_id"], OK | DATA, "SELECT event_id, event_type IN ('click', 'view') AS success, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) END AS data FROM events")
_parsed("coerce_number", "events", z.number(coerce=True).min(100), lambda: E("CASE WHEN event_id % 3 = 0 THEN concat(' ', cast(user_id AS string)) WHEN event_id % 3 = 1 THEN '' ELSE 'x1' END"), ["event_id"], OK | DATA, "SELECT event_id, event_id % 3 = 0 AND user_id >= 100 AS success, CASE WHEN event_id % 3 = 0 AND user_id >= 100 THEN user_id::DOUBLE END AS data FROM events")
_parsed("coerce_string", "events", z.string(coerce=True), lambda: C("user_id"), ["event_id"], DATA, "SELECT event_id, user_id::VARCHAR AS data FROM events")
_parsed("coerce_boolean", "events", z.boolean(coerce=True), lambda: E("user_id % 3"), ["event_id"], DATA, "SELECT event_id, user_id % 3 <> 0 AS data FROM events")
_parsed("coerce_bigint", "events", z.bigint(coerce=True), lambda: E("CASE WHEN event_id % 2 = 0 THEN cast(user_id AS string) ELSE '1.5' END"), ["event_id"], {"success": lambda: C("success"), "data": lambda: C("data").cast("long")}, "SELECT event_id, event_id % 2 = 0 AS success, CASE WHEN event_id % 2 = 0 THEN user_id END AS data FROM events")
_parsed("coerce_date", "events", z.date(coerce=True), lambda: E("user_id * 1000"), ["event_id"], {"data": lambda: F.unix_millis("data")}, "SELECT event_id, user_id * 1000 AS data FROM events")
_parsed("nonoptional", "events", _s().optional().nonoptional(), lambda: E("nullif(event_type, 'click')"), ["event_id"], OK | CODES, "SELECT event_id, event_type <> 'click' AS success, CASE WHEN event_type = 'click' THEN 'invalid_type' ELSE '' END AS codes FROM events")
_parsed("success_wrapper", "events", _s().max(4).success(), lambda: C("event_type"), ["event_id"], DATA, "SELECT event_id, length(event_type) <= 4 AS data FROM events")
_parsed("native_enum", "events", z.native_enum({"A": 1, "B": 2, "C": "x"}), lambda: E("user_id % 4"), ["event_id"], OK, "SELECT event_id, user_id % 4 IN (1, 2) AS success FROM events")
_parsed("nan_leaf", "events", z.nan(), lambda: E("CASE WHEN event_id % 2 = 0 THEN double('NaN') ELSE value END"), ["event_id"], OK, "SELECT event_id, event_id % 2 = 0 AS success FROM events")
_parsed("number_specials", "events", _n(), lambda: E("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -double('Infinity') ELSE value END"), ["event_id"], OK | CODES, "SELECT event_id, event_id % 4 = 3 AS success, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'invalid_type' END AS codes FROM events")
_parsed("nullable_null", "events", _s().nullable(), lambda: E("nullif(event_type, 'click')"), ["event_id"], OK | DATA, "SELECT event_id, true AS success, nullif(event_type, 'click') AS data FROM events", null_means="null")
_parsed("issues_collect", "events", _s().min(5).max(5).regex("^[a-e]").includes("i"), lambda: C("event_type"), ["event_id"], OK | CODES | N_ISSUES, "SELECT event_id, len(l) = 0 AS success, array_to_string(l, ',') AS codes, len(l) AS n_issues FROM (SELECT event_id, list_filter([CASE WHEN length(event_type) < 5 THEN 'too_small' END, CASE WHEN length(event_type) > 5 THEN 'too_big' END, CASE WHEN NOT regexp_matches(event_type, '^[a-e]') THEN 'invalid_string' END, CASE WHEN NOT contains(event_type, 'i') THEN 'invalid_string' END], lambda x: x IS NOT NULL) AS l FROM events)")
_parsed("refine_abort", "events", _s().refine(lambda v: v != "click", "no", abort=True).max(3), lambda: C("event_type"), ["event_id"], CODES | MESSAGES, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'custom' ELSE 'too_big' END AS codes, CASE WHEN event_type = 'click' THEN 'no' ELSE 'String must contain at most 3 character(s)' END AS messages FROM events")

_EMB = "list_transform(embedding, lambda x: x::DOUBLE)"
_parsed("array_elements_ok", "embeddings", z.array(_n().min(-0.2).max(0.2)).min(1), lambda: E("cast(embedding AS array<double>)"), ["vec_id"], OK | N_ISSUES, f"SELECT vec_id, n = 0 AS success, n AS n_issues FROM (SELECT vec_id, len(list_filter({_EMB}, lambda x: x < -0.2 OR x > 0.2)) AS n FROM embeddings)")
_parsed("array_length", "embeddings", z.array(_n()).length(64), lambda: E("slice(embedding, 1, 62 + cast(vec_id % 5 AS int))"), ["vec_id"], OK | CODES, "SELECT vec_id, vec_id % 5 >= 2 AS success, CASE WHEN vec_id % 5 < 2 THEN 'too_small' ELSE '' END AS codes FROM embeddings")
_parsed("tuple_optional_tail", "embeddings", z.tuple_(_n(), _n().optional()), lambda: E("cast(slice(embedding, 1, cast(vec_id % 4 AS int)) AS array<double>)"), ["vec_id"], OK | {"a": lambda: C("data._1"), "b": lambda: C("data._2")}, f"SELECT vec_id, vec_id % 4 IN (1, 2) AS success, CASE WHEN vec_id % 4 IN (1, 2) THEN {_EMB}[1] END AS a, CASE WHEN vec_id % 4 = 2 THEN {_EMB}[2] END AS b FROM embeddings")
_parsed("tuple_rest", "embeddings", z.tuple_(_n(), rest=_n().min(0)), lambda: E("cast(slice(embedding, 1, 4) AS array<double>)"), ["vec_id"], OK | {"n_rest": lambda: F.size("data.rest").cast("long")}, f"SELECT vec_id, ok AS success, CASE WHEN ok THEN 3 END AS n_rest FROM (SELECT vec_id, len(list_filter({_EMB}[2:4], lambda x: x < 0)) = 0 AS ok FROM embeddings)")
_parsed("set_collision", "events", z.set_(_s().lower()), lambda: E("array(event_type, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE 'y' END, 'z')"), ["event_id"], {"data": lambda: F.array_join("data", ",")} | DIRTY, "SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',y' END || ',z' AS data, event_id % 2 = 0 AS dirty FROM events")
_parsed("record_value_rewrite", "events", z.record(_s(), _s().upper()), lambda: E("map('b', event_type, 'a', 'X')"), ["event_id"], {"data": lambda: F.concat_ws(",", F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))} | DIRTY, "SELECT event_id, 'b=' || upper(event_type) || ',a=X' AS data, true AS dirty FROM events")
_parsed("record_enum_keys", "events", z.record(z.enum("a", "b"), _n()), lambda: E("map('b', value, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'c' END, value)"), ["event_id"], OK | CODES | PATHS, "SELECT event_id, event_id % 2 = 0 AS success, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'invalid_type,unrecognized_keys' END AS codes, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'a,' END AS paths FROM events")
_parsed("record_loose_keys", "events", z.record(_s().regex("^a"), _n().max(100), loose=True), lambda: E("map('a', value, 'z', value * 100)"), ["event_id"], OK, "SELECT event_id, value <= 100 AS success FROM events")
_parsed("record_numeric_keys", "events", z.record(_n(), _n()), lambda: E("map(CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '12' END, value)"), ["event_id"], OK, "SELECT event_id, event_id % 3 <> 0 AS success FROM events")
_parsed("map_key_collision", "events", z.map_(_s().lower(), _n()), lambda: E("map('K', 1.0D, 'j', 2.0D, 'k', value)"), ["event_id"], {"data": lambda: F.array_join(F.map_keys("data"), ","), "k": lambda: C("data")["k"]}, "SELECT event_id, 'k,j' AS data, value AS k FROM events")
_parsed("map_size_paths", "events", z.map_(_s().max(1), _n().max(100)).max(1), lambda: E("map('ab', value, 'c', value)"), ["event_id"], CODES | PATHS, "SELECT event_id, 'too_big' || CASE WHEN value > 100 THEN ',too_big,too_big' ELSE '' END || ',too_big' AS codes, '0.key,' || CASE WHEN value > 100 THEN '0.value,1.value,' ELSE '' END AS paths FROM events")

_JSON = "parse_json(concat('{\"k\":', user_id, CASE WHEN event_id % 2 = 0 THEN ',\"x\":1' ELSE '' END, '}'))"
_parsed("object_strip_variant", "events", z.object_({"k": _n().int()}), lambda: E(_JSON), ["event_id"], OK | {"k": lambda: C("data.k")} | DIRTY, "SELECT event_id, true AS success, user_id::DOUBLE AS k, event_id % 2 = 0 AS dirty FROM events")
_parsed("object_strict_extras", "events", z.object_({"k": _n().max(100)}).strict(), lambda: E(_JSON), ["event_id"], OK | CODES, "SELECT event_id, event_id % 2 = 1 AND user_id <= 100 AS success, array_to_string(list_filter([CASE WHEN user_id > 100 THEN 'too_big' END, CASE WHEN event_id % 2 = 0 THEN 'unrecognized_keys' END], lambda x: x IS NOT NULL), ',') AS codes FROM events")
_parsed("object_loose_extras", "events", z.object_({"k": _n()}).loose(), lambda: E(_JSON), ["event_id"], {"x": lambda: C("data._extras")["x"].cast("long")} | DIRTY, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 END::BIGINT AS x, false AS dirty FROM events")
_parsed("object_catchall", "events", z.object_({"k": _n()}).catchall(_s()), lambda: E(_JSON), ["event_id"], OK | PATHS, "SELECT event_id, event_id % 2 = 1 AS success, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS paths FROM events")
_parsed("variant_presence", "events", z.object_({"a": _n().optional(), "b": _n().nullable()}), lambda: E("parse_json(CASE event_id % 4 WHEN 0 THEN '{\"a\":1,\"b\":null}' WHEN 1 THEN '{\"b\":2}' WHEN 2 THEN '{\"a\":null,\"b\":1}' ELSE '{\"a\":1}' END)"), ["event_id"], OK | PATHS | MESSAGES, "SELECT event_id, event_id % 4 < 2 AS success, CASE event_id % 4 WHEN 2 THEN 'a' WHEN 3 THEN 'b' ELSE '' END AS paths, CASE event_id % 4 WHEN 2 THEN 'Expected number, received null' WHEN 3 THEN 'Required' ELSE '' END AS messages FROM events")
_TYPES = "parse_json(concat('{\"s\":', CASE event_id % 3 WHEN 0 THEN '5' WHEN 1 THEN '\"x\"' ELSE 'null' END, ',\"t\":', CASE event_id % 2 WHEN 0 THEN 'true' ELSE '1' END, ',\"l\":[1,', user_id, CASE event_id % 5 WHEN 0 THEN ',\"x\"' ELSE '' END, ']}'))"
_parsed("variant_types", "events", z.object_({"s": _s(), "t": z.boolean(), "l": z.array(_n())}), lambda: E(_TYPES), ["event_id"], OK | MESSAGES | PATHS, "SELECT event_id, len(m) = 0 AS success, array_to_string(m, '; ') AS messages, array_to_string(p, ',') AS paths FROM (SELECT event_id, list_filter([CASE event_id % 3 WHEN 0 THEN 'Expected string, received number' WHEN 2 THEN 'Expected string, received null' END, CASE WHEN event_id % 2 = 1 THEN 'Expected boolean, received number' END, CASE WHEN event_id % 5 = 0 THEN 'Expected number, received string' END], lambda x: x IS NOT NULL) AS m, list_filter([CASE WHEN event_id % 3 <> 1 THEN 's' END, CASE WHEN event_id % 2 = 1 THEN 't' END, CASE WHEN event_id % 5 = 0 THEN 'l.2' END], lambda x: x IS NOT NULL) AS p FROM events)")
_parsed("nested_object_paths", "events", z.object_({"a": z.object_({"b": _s().max(4)}), "c": _n().max(50)}), lambda: E("named_struct('a', named_struct('b', event_type), 'c', value)"), ["event_id"], PATHS, "SELECT event_id, array_to_string(list_filter([CASE WHEN length(event_type) > 4 THEN 'a.b' END, CASE WHEN value > 50 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS paths FROM events")
_parsed("property_check", "events", z.object_({"a": _s(), "c": _n()}).property("c", _n().max(50)), lambda: E("named_struct('a', event_type, 'c', value)"), ["event_id"], OK | PATHS, "SELECT event_id, value <= 50 AS success, CASE WHEN value <= 50 THEN '' ELSE 'c' END AS paths FROM events")

_parsed("union_first_match", "events", z.union(_n().max(50).transform(lambda v: v * 2), _n().max(100)), lambda: C("value"), ["event_id"], OK | DATA, "SELECT event_id, value <= 100 AS success, CASE WHEN value <= 50 THEN value * 2 WHEN value <= 100 THEN value END AS data FROM events")
_parsed("union_dirty_preference", "events", z.union(z.literal("click"), _s().max(4), z.boolean()), lambda: C("event_type"), ["event_id"], OK | CODES, "SELECT event_id, event_type = 'click' OR length(event_type) <= 4 AS success, CASE WHEN event_type = 'click' OR length(event_type) <= 4 THEN '' ELSE 'too_big' END AS codes FROM events", dialect="v3")
_parsed("union_invalid", "events", z.union(z.literal("click"), z.boolean()), lambda: C("event_type"), ["event_id"], CODES, "SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE 'invalid_union' END AS codes FROM events")
_parsed("xor", "events", z.xor(_n().max(100), _n().min(50)), lambda: C("value"), ["event_id"], OK | DATA, "SELECT event_id, value < 50 OR value > 100 AS success, CASE WHEN value < 50 OR value > 100 THEN value END AS data FROM events")
_parsed("intersection", "events", z.intersection(_n().max(100), _n().min(50)), lambda: C("value"), ["event_id"], OK, "SELECT event_id, value BETWEEN 50 AND 100 AS success FROM events")
_parsed("discriminated_dispatch", "events", z.discriminated_union("t", z.object_({"t": z.literal("click"), "v": _n().max(100)}), z.object_({"t": z.enum("view", "error"), "v": _n().min(20)})), lambda: E("named_struct('t', event_type, 'v', value)"), ["event_id"], OK | CODES | PATHS, "SELECT event_id, c = '' AS success, c AS codes, CASE c WHEN '' THEN '' WHEN 'invalid_union_discriminator' THEN 't' ELSE 'v' END AS paths FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value <= 100 THEN '' ELSE 'too_big' END WHEN event_type IN ('view', 'error') THEN CASE WHEN value >= 20 THEN '' ELSE 'too_small' END ELSE 'invalid_union_discriminator' END AS c FROM events)")
_parsed("optional_over_default", "events", _s().default("d").optional(), lambda: E("nullif(event_type, 'click')"), ["event_id"], DATA, "SELECT event_id, coalesce(nullif(event_type, 'click'), 'd') AS data FROM events")
_parsed("optional_over_default_v3", "events", _s().default("d").optional(), lambda: E("nullif(event_type, 'click')"), ["event_id"], DATA, "SELECT event_id, nullif(event_type, 'click') AS data FROM events", dialect="v3")


def _paths(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", E("cast(embedding AS array<double>)").alias("v"))
    done = compile(z.array(_n().max(0)), df, "v").safe_parse(df)
    return done.select("vec_id", F.explode("issues").alias("i")).select("vec_id", F.array_join("i.path", ".").cast("long").alias("at"))


QUERIES["issue_paths_array"], SQL["issue_paths_array"] = _paths, f"SELECT vec_id, i - 1 AS at FROM (SELECT vec_id, {_EMB} AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE e[i] > 0"

EVENT = z.object_({"event_id": z.bigint(), "event_type": z.enum("click", "view", "purchase", "signup", "error").default("other"), "value": _n().min(1).max(100)})


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Valid, normalized events with a dirty flag, and the issues of the others."""
    df = table(spark, sf, "events").select("event_id", E("nullif(event_type, 'error')").alias("event_type"), "value")
    return compile(EVENT, df).safe_parse(df).select("event_id", "success", C("data.event_type").alias("event_type"), C("data.value").alias("value"), "dirty", *[c().alias(k) for k, c in CODES.items()])


QUERIES["safe_parse_events"] = flagship
SQL["safe_parse_events"] = "SELECT event_id, ok AS success, CASE WHEN ok THEN t END AS event_type, CASE WHEN ok THEN value END AS value, ok AND event_type = 'error' AS dirty, CASE WHEN value < 1 THEN 'too_small' WHEN value > 100 THEN 'too_big' ELSE '' END AS codes FROM (SELECT *, value BETWEEN 1 AND 100 AS ok, CASE WHEN event_type = 'error' THEN 'other' ELSE event_type END AS t FROM events)"
QUERIES["quality_report"] = lambda spark, sf: compile(z.object_({"value": _n().min(5).max(100), "event_type": z.enum("click", "view")}), table(spark, sf, "events")).report(table(spark, sf, "events"))
SQL["quality_report"] = "SELECT code, path, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN value < 5 THEN {'code': 'too_small', 'path': 'value'} END, CASE WHEN value > 100 THEN {'code': 'too_big', 'path': 'value'} END, CASE WHEN event_type NOT IN ('click', 'view') THEN {'code': 'invalid_enum_value', 'path': 'event_type'} END], lambda x: x IS NOT NULL), recursive := true) FROM events) GROUP BY code, path"
QUERIES["check_count"] = lambda spark, sf: check_count(table(spark, sf, "orders"), 1, 10**9)
SQL["check_count"] = "SELECT count(*) AS n, count(*) BETWEEN 1 AND 1000000000 AS ok FROM orders"
QUERIES["check_count_many"] = lambda spark, sf: check_count(table(spark, sf, "orders"), 10**9)
SQL["check_count_many"] = "SELECT count(*) AS n, count(*) >= 1000000000 AS ok FROM orders"
QUERIES["parse_events"] = lambda spark, sf: (lambda df: compile(z.object_({"value": _n().min(0)}), df).parse(df).select("event_id", C("data.value").alias("value")))(table(spark, sf, "events"))
SQL["parse_events"] = "SELECT event_id, value FROM events"
QUERIES["refine_udf"] = lambda spark, sf: (lambda df: compile(z.object_({"event_type": _s().refine_udf(lambda s: s.str.len() > 4)}), df).validate(df).select("event_id"))(table(spark, sf, "events"))
SQL["refine_udf"] = "SELECT event_id FROM events WHERE length(event_type) > 4"
QUERIES["format_url"] = lambda spark, sf: (lambda df: compile(z.object_({"url": _s().url()}), df).validate(df).select("page_id", "url"))(table(spark, sf, "pages").withColumn("url", E("CASE WHEN page_id % 4 = 0 THEN replace(url, '://', ' ') WHEN page_id % 4 = 1 THEN 'no url' ELSE url END")))
SQL["format_url"] = "SELECT page_id, url FROM pages WHERE page_id % 4 > 1"


def _chosen(name: str, schema: z.Schema, cases: list[tuple[str, str]], out: dict[str, Callable[[], Column]] = OK, column: str = "success", **options) -> None:
    """Values in turn (event_id modulo their number), as SQL that both engines read, with what `column` must be for each."""
    n = len(cases)
    made = "CASE event_id % " + str(n) + "".join(f" WHEN {k} THEN {v}" for k, (v, _) in enumerate(cases)) + " END"
    want = "CASE event_id % " + str(n) + "".join(f" WHEN {k} THEN {w}" for k, (_, w) in enumerate(cases)) + " END"
    _parsed(name, "events", schema, lambda: E(made), ["event_id"], out, f"SELECT event_id, {want} AS {column} FROM events", **options)


T_, F_ = "true", "false"
_chosen("format_jwt", _s().format("jwt"), [("'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.e30.x'", T_), ("'eyJhbGciOiJIUzI1NiJ9.e30.x'", F_), ("'a.b.c'", F_), ("'eyJ0eXAiOiJKV1QiLCJhbGciOiJub25lIn0.e30.'", T_), ("'eyJ0eXAiOiJKV1QiLCJhbGciOiJub25lIn0.e30'", F_)])
_chosen("format_emoji", _s().format("emoji"), [("'\U0001f600'", T_), ("'\U0001f44d\U0001f3fd'", T_), ("'a'", F_), ("''", F_), ("'\U0001f600a'", F_), ("'5️⃣'", T_), ("'→'", F_), ("'↔'", T_), ("'©'", T_)])
_chosen("format_ipv6", _s().format("ip", version="v6"), [("'::1'", T_), ("'1:2:3:4:5:6:7:8'", T_), ("'fe80::1%eth0'", T_), ("'::ffff:1.2.3.4'", T_), ("'1:2'", F_), ("'1.2.3.4'", F_), ("'1::2::3'", F_), ("'2001:db8::g'", F_)])
_chosen("format_cidrv6", _s().format("cidr", version="v6"), [("'::/0'", T_), ("'2001:db8::/128'", T_), ("'::/129'", F_), ("'1.2.3.4/8'", F_)])
_chosen("format_time_precision", _s().format("time", precision=3), [("'10:11:12.123'", T_), ("'10:11:12'", F_), ("'10:11:12.12'", F_), ("'24:00:00.000'", F_)])
_chosen("string_format_custom", z.string_format("even", "^([0-9]*[02468]|none)$"), [("'12'", "''"), ("'13'", "'invalid_string'"), ("'none'", "''"), ("concat('none', chr(10))", "'invalid_string'")], CODES, "codes")
_chosen("multiple_of_decimals", _n().multiple_of(0.1), [("0.3D", T_), ("cast('0.30000000000000004' AS double)", F_), ("cast('0.1234567890123' AS double)", F_), ("cast('0.7' AS double)", T_), ("cast('1e-7' AS double)", T_), ("cast('1.25e-7' AS double)", T_), ("cast('12345678.9' AS double)", T_)])
_chosen("multiple_of_small", _n().multiple_of(1e-13), [("cast('0.1234567890123' AS double)", T_), ("cast('0.12345678901234' AS double)", F_), ("cast('3' AS double)", T_)])
_chosen("regex_ends", _s().regex(r"a$|^(xb|c$)$|\$$"), [("'a'", T_), ("concat('a', chr(10))", F_), ("'xb'", T_), ("concat('c', chr(10))", F_), ("'c'", T_), ("'5$'", T_), ("'q'", F_)])
_chosen("regex_flags", _s().regex("^cl.CK$", flags="is").regex("^c[a-z$.]", flags="i"), [("'CLICK'", T_), ("concat('cl', chr(10), 'ck')", T_), ("'clack!'", F_), ("'xclick'", F_)])
_chosen("regex_lines", _s().regex("^b.$", flags="m"), [("concat('a', chr(10), 'bc', chr(10), 'd')", T_), ("concat('a', chr(10), 'bcd')", F_), ("'bx'", T_), ("concat('b', chr(10))", F_)])
_chosen("null_leaf", z.null(), [("NULL", T_), ("event_type", F_)], null_means="null")
_chosen("void_leaf", z.void(), [("NULL", "''"), ("event_type", "'invalid_type'")], CODES, "codes")
_chosen("invalid_date", z.date(coerce=True), [("'2020-01-02'", "''"), ("'no date'", "'Invalid date'")], MESSAGES, "messages")
_chosen("invalid_literal", z.literal("click"), [("'click'", "''"), ("'x'", "'Invalid literal value, expected \"click\"'")], MESSAGES, "messages")
_chosen("native_enum_text", z.native_enum({"A": 1, "B": "b"}), [("'b'", "''"), ("'q'", "'Invalid enum value. Expected 1 | ''b'', received ''q'''")], MESSAGES, "messages")
_chosen("native_enum_type", z.native_enum({"A": 1, "B": "b"}), [("true", "'Expected 1 | ''b'', received boolean'"), ("NULL", "'Required'")], MESSAGES, "messages")
_chosen("int_issue", _n().int(), [("2.5D", "'Expected integer, received float'"), ("2D", "''")], MESSAGES, "messages")
_chosen("not_multiple", _n().multiple_of(3), [("4D", "'not_multiple_of'"), ("6D", "''")], CODES, "codes")
_chosen("not_finite", _n().finite(), [("double('Infinity')", "'not_finite'"), ("6D", "''")], CODES, "codes", dialect="v3")
SQL["multiple_of_decimals"] = SQL["multiple_of_decimals"].replace("0.3D", "0.3")
_chosen("union_refined", z.union(z.literal("a"), z.literal("b")).refine(lambda v: v != "b", "not b"), [("'a'", "''"), ("'b'", "'not b'"), ("'c'", "'Invalid input'")], MESSAGES, "messages")
_chosen("exact_optional", z.string().exact_optional(), [("'a'", T_), ("NULL", T_)])
_chosen("readonly_brand", _s().max(1).readonly().brand("short"), [("'a'", T_), ("'ab'", F_)])
_chosen("codec", z.codec(_s().regex("^[0-9]+$"), z.number().max(20), lambda v: v.try_cast("double"), "double"), [("'12'", "12"), ("'30'", "NULL"), ("'x'", "NULL")], {"data": lambda: C("data").cast("long")}, "data")
_chosen("wrapper_sizes", _s().optional().min(2).nullable(), [("NULL", T_), ("'a'", F_), ("'ab'", T_)])
_chosen("wrapper_range", _n().nullable().max(2), [("NULL", "'too_big'"), ("1D", "''"), ("3D", "'too_big'")], CODES, "codes", null_means="null")
_chosen("default_checked", _s().default("z").min(3), [("NULL", "'String must contain at least 3 character(s)'"), ("'abc'", "''")], MESSAGES, "messages")
_chosen("message_maps", _s().min(3).max(4, "at most four").messages({"too_small": "need {minimum}, given less"}), [("'a'", "'need 3, given less'"), ("'abcde'", "'at most four'"), ("NULL", "'give me string'")], MESSAGES, "messages", messages={"too_small": "never", "too_big": "never", "invalid_type": "give me {expected}"})
_chosen("super_refine_fatal", _s().super_refine(lambda v: F.when(v == "a", F.array(issue("custom", [], "no a", fatal="true"))).otherwise(none())).refine(lambda v: v > "b", "not above b"), [("'a'", "'no a'"), ("'aa'", "'not above b'"), ("'c'", "''")], MESSAGES, "messages")
_chosen("super_refine_value", _s().super_refine(lambda v: none(), value=F.reverse), [("'ab'", "'ba'"), ("'x'", "'x'")], DATA, "data")
_chosen("set_variant", z.set_(_n()), [("parse_json('[1, 2, 1]')", "'[1,2]'"), ("parse_json('[]')", "'[]'"), ("parse_json('[\"a\"]')", "NULL")], {"data": lambda: F.to_json("data")}, "data")
SQL["set_variant"] = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[1.0,2.0]' WHEN 1 THEN '[]' END AS data FROM events"
_chosen("coerce_variant", z.number(coerce=True).max(5), [("parse_json('\"4\"')", "4"), ("parse_json('true')", "1"), ("parse_json('null')", "0"), ("parse_json('\"x\"')", "NULL"), ("parse_json('9')", "NULL"), ("parse_json('[3]')", "3")], {"data": lambda: F.try_variant_get("data", "$", "long")}, "data")
SQL["coerce_variant"] = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 5 THEN 3 END AS data FROM events"
_parsed("record_loose_any_key", "events", z.record(_s(), _n().max(100), loose=True), lambda: E("map('a', value, 'b', 1.0D)"), ["event_id"], OK, "SELECT event_id, value <= 100 AS success FROM events")
_parsed("record_partial", "events", z.record(z.enum("a", "b"), _n(), partial=True), lambda: E("map(CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'c' END, value)"), ["event_id"], OK | CODES | PATHS, "SELECT event_id, event_id % 2 = 0 AS success, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'invalid_enum_value' END AS codes, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'c' END AS paths FROM events")
_parsed("record_v3", "events", z.record(_s().max(1), _n().max(100)), lambda: E("map('ab', value)"), ["event_id"], CODES | PATHS, "SELECT event_id, 'too_big' || CASE WHEN value > 100 THEN ',too_big' ELSE '' END AS codes, 'ab' || CASE WHEN value > 100 THEN ',ab' ELSE '' END AS paths FROM events", dialect="v3")
_X = "parse_json(concat('{\"k\":1', CASE WHEN event_id % 2 = 0 THEN concat(',\"x\":\"', event_type, '\"') ELSE '' END, '}'))"
_parsed("catchall_values", "events", z.object_({"k": _n()}).catchall(_s().upper()), lambda: E(_X), ["event_id"], {"x": lambda: C("data._extras")["x"]} | DIRTY, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) END AS x, event_id % 2 = 0 AS dirty FROM events")
_parsed("catchall_columns", "events", z.object_({"k": _n()}).catchall(_s().max(4)), lambda: E("named_struct('k', value, 'a', event_type, 'b', nullif(event_type, 'click'))"), ["event_id"], PATHS, "SELECT event_id, CASE WHEN length(event_type) <= 4 THEN '' WHEN event_type = 'click' THEN 'a' ELSE 'a,b' END AS paths FROM events")
_parsed("refine_udf_members", "events", z.array(_n().refine_udf(lambda s: s <= 100, "too much")), lambda: E("array(value, 1.0D)"), ["event_id"], OK | PATHS | MESSAGES, "SELECT event_id, value <= 100 AS success, CASE WHEN value <= 100 THEN '' ELSE '0' END AS paths, CASE WHEN value <= 100 THEN '' ELSE 'too much' END AS messages FROM events")
_parsed("transform_udf_members", "events", z.array(_s().transform_udf(lambda s: s.str.upper())), lambda: E("array(event_type, 'b')"), ["event_id"], {"data": lambda: F.to_json("data")}, "SELECT event_id, '[\"' || upper(event_type) || '\",\"B\"]' AS data FROM events")

NEST = z.object_({"v": _n().max(50).optional(), "kid": z.lazy(lambda: NEST).optional()})
_parsed("recursive_json", "events", NEST, lambda: E("parse_json(concat(repeat('{\"kid\":', cast(event_id % 30 AS int)), '{\"v\":', value, '}', repeat('}', cast(event_id % 30 AS int))))"), ["event_id"], OK | PATHS, "SELECT event_id, value <= 50 AS success, CASE WHEN value <= 50 THEN '' ELSE repeat('kid.', event_id % 30) || 'v' END AS paths FROM events")
_parsed("tuple_length", "embeddings", z.tuple_(_n(), _n().optional(), _n().default(7.0), _n().optional()), lambda: E("cast(slice(embedding, 1, cast(vec_id % 6 AS int)) AS array<double>)"), ["vec_id"], {"length": lambda: C("data._length"), "third": lambda: C("data._3")}, f"SELECT vec_id, CASE WHEN n IN (1, 2, 3) THEN 3 WHEN n = 4 THEN 4 END AS length, CASE WHEN n IN (1, 2) THEN 7.0 WHEN n IN (3, 4) THEN {_EMB}[3] END AS third FROM (SELECT vec_id, embedding, vec_id % 6 AS n FROM embeddings)")
QUERIES["error_text"] = lambda spark, sf: (lambda df: compile(z.object_({"value": _n().max(100), "event_type": z.enum("click", "view")}), df).errors(df).select("event_id", "error"))(table(spark, sf, "events").select("event_id", "value", "event_type"))
SQL["error_text"] = "SELECT event_id, nullif(array_to_string(list_filter([CASE WHEN value > 100 THEN '[too_big] value: Number must be less than or equal to 100' END, CASE WHEN event_type NOT IN ('click', 'view') THEN '[invalid_enum_value] event_type: Invalid enum value. Expected ''click'' | ''view'', received ''' || event_type || '''' END], lambda x: x IS NOT NULL), '; '), '') AS error FROM events"
QUERIES["validate_v3"] = lambda spark, sf: (lambda df: compile(z.object_({"event_type": _s().upper()}), df, dialect="v3").validate(df).select("event_id", C("data.event_type").alias("event_type")))(table(spark, sf, "events").select("event_id", "event_type"))
SQL["validate_v3"] = "SELECT event_id, upper(event_type) AS event_type FROM events"
