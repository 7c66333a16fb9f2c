"""From schemas to columns.

lower() gives, for an input column of a known Spark type, five columns: value, ok, aborted, issues, dirty. ok never
depends on the issues array, so that plain checks on plain columns stay a conjunction that Catalyst can push to a scan.
A VARIANT input is tested at run time; any other type settles most type tests here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colguard import regexes
from colguard.issues import Message, issue, none, size_message, wrong_type
from colguard.nodes import Check, Schema, UnsupportedInSpark, is_recursive, resolved, walk

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Node:
    """aborted may be given as a function, so that it is only built where it is asked for."""

    def __init__(self, value: Column, ok: Column, issues: Callable[[], Column], aborted: Column | Callable[[], Column], dirty: Column | None, dtype: T.DataType):
        self.value, self.ok, self.dirty, self.dtype = value, ok, dirty, dtype  # dirty None: never
        self.issues = issues  # built when asked for: validate() never needs them
        self._aborted = aborted

    @property
    def aborted(self) -> Column:
        if not isinstance(self._aborted, Column):
            self._aborted = self._aborted()
        return self._aborted


@dataclass(frozen=True)
class Options:
    dialect: str = "v4"
    null_means: str = "undefined"
    messages: dict[str, Message] = field(default_factory=dict)
    own: dict[str, Message] = field(default_factory=dict)  # of the schema that is lowered
    open: tuple[int, ...] = ()  # lazy schemas on the way here
    quick: bool = False  # nobody asks for the value that comes out, nor whether it is dirty

    @property
    def maps(self) -> tuple[dict[str, Message], ...]:
        return tuple(m for m in (self.messages, self.own) if m)


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


class In:
    """One input: how to ask for absence, null and type."""

    def __init__(self, x: Column, dtype: T.DataType, opt: Options, present: bool = False):
        self.x, self.dtype, self.opt, self.present = x, dtype, opt, present
        self.variant = isinstance(dtype, T.VariantType)

    def absent(self) -> Column:
        return self.x.isNull() if self.variant or self.opt.null_means == "undefined" else F.lit(False)

    def null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.x), F.lit(False)) if self.variant else self.x.isNull() if self.opt.null_means == "null" else F.lit(False)

    def shape(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.x), F.lit(""))

    def received(self) -> Column:
        if not self.variant:
            t = self.dtype
            name = "string" if isinstance(t, T.StringType) else "number" if isinstance(t, NUMBERS) else "boolean" if isinstance(t, T.BooleanType) else "array" if isinstance(t, T.ArrayType) else "map" if isinstance(t, T.MapType) else "object" if isinstance(t, T.StructType) else "date" if isinstance(t, T.TimestampType | T.DateType | T.TimestampNTZType) else "unknown"
            out = F.when(F.isnan(self.x), "nan").otherwise(name) if isinstance(t, T.DoubleType | T.FloatType) else F.lit(name)
            return F.when(self.x.isNull(), F.lit("undefined" if self.opt.null_means == "undefined" else "null")).otherwise(out)
        s = self.shape()
        return (
            F.when(self.x.isNull(), "undefined").when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object").otherwise("number")
        )

    def typed(self, kinds: tuple, cast: str, test: str) -> tuple[Column, Column]:
        """(is of the type, value of the type where it is)"""
        if self.variant:
            return self.shape().rlike(test) if test.startswith("^") else self.shape() == test, F.try_variant_get(self.x, "$", cast)
        if not isinstance(self.dtype, kinds):
            return F.lit(False), F.lit(None).cast(cast)
        return self.x.isNotNull(), self.x


#: What schema_of_variant calls numbers
_NUM = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _leaf(name: str, ok: Column, value: Column, dtype: T.DataType, i: In, path: list[Column], said=None) -> Node:
    return Node(value, ok, lambda: F.when(ok, none()).otherwise(F.array(said() if said else wrong_type(path, name, i.received(), i.opt.maps))), ~ok, None, dtype)


def _length(x: Column, opt: Options) -> Column:
    """Characters: code points in v4, UTF-16 units in v3."""
    return F.length(x) if opt.dialect == "v4" else (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def _format(x: Column, name: str, args: dict) -> Column:
    match = lambda p: x.rlike(p)
    if "test" in args:
        return match(regexes.java(args["test"])) if isinstance(args["test"], str) else F.coalesce(args["test"](x), F.lit(False))
    if name == "emoji":
        return match(regexes.emoji())
    if name in ("ip", "cidr"):
        kinds = {"v4": [f"{name}v4"], "v6": [f"{name}v6"], None: [f"{name}v4", f"{name}v6"]}[args.get("version")]
        return reduce(lambda a, b: a | b, [match(regexes.FORMATS[k]) for k in kinds])
    if name == "time":
        return match(rf"^{regexes.time(args.get('precision'))}\z")
    if name == "datetime":
        return match(regexes.datetime(args.get("precision"), args.get("offset", False), args.get("local", False)))
    if name == "url":
        return F.regexp_replace(x, regexes.URL_ENDS, "").rlike(regexes.url())
    if name == "jwt":
        head = F.split(x, r"\.")[0]
        head = F.rpad(F.translate(head, "-_", "+/"), (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
        v = F.try_parse_json(F.decode(F.try_to_binary(head, F.lit("base64")), "UTF-8"))
        said = [F.coalesce(F.length(F.try_variant_get(v, f"$.{k}", "string")) > 0, F.lit(False)) for k in ("typ", "alg")]
        if args.get("alg"):
            said.append(F.coalesce(F.try_variant_get(v, "$.alg", "string") == args["alg"], F.lit(False)))
        return match(regexes.FORMATS["jwt"]) & all_of(said)
    if name not in regexes.FORMATS:
        raise UnsupportedInSpark(f"string format {name!r}")
    return match(regexes.FORMATS[name])


def _whole(v: Column, dtype: T.DataType, n) -> Column:
    """Whether v is a multiple of n: in decimal digits, the longer fraction of the two sets the scale. A number under a
    millionth is first rounded to that many places, where its short text in exponent form counts as a fraction."""
    if n == 0:
        return F.lit(False)
    if isinstance(dtype, T.ByteType | T.ShortType | T.IntegerType | T.LongType) and float(n).is_integer():
        return v % F.lit(int(n)) == 0
    exact = lambda kind: F.try_mod(F.expr("1") * v.try_cast(kind), F.lit(format(n, "f") if isinstance(n, int) else format(Decimal(repr(n)), "f")).cast(kind)) == 0
    x = F.abs(v.cast("double"))
    text = F.regexp_extract(x.cast("string"), r"^(\d)\.(\d+)E-(\d+)", 2)
    count = F.when(text.isin("0", ""), 0).otherwise(F.length(text) + 2 + F.length(F.regexp_extract(x.cast("string"), r"E-(\d+)", 1)))
    places = max(0, -Decimal(repr(n)).as_tuple().exponent) if not float(n).is_integer() else 0
    up = F.pow(F.lit(10.0), F.greatest(count, F.lit(places)))
    tiny = F.floor(x * up + 0.5).try_cast("decimal(38,0)") % F.greatest(F.floor(F.lit(abs(float(n))) * up + 0.5), F.lit(1)).try_cast("decimal(38,0)") == 0
    return F.coalesce(F.when((x > 0) & (x < 1e-6), tiny).when(x < 1e15, exact("decimal(38,22)")).otherwise(exact("decimal(38,6)")), F.lit(False))


def _test(of: str, c: Check, v: Column, dtype: T.DataType, opt: Options, path: list[Column], skip: bool) -> list[tuple[Column, Callable[[], Column]]]:
    """Each part of a check: whether it holds, and the issue if not. skip: sizes of a null value hold."""
    a = c.args
    say = lambda code, said, **params: issue(code, path, said, c.message, opt.maps, **params)
    sized = {"string": lambda: _length(v, opt), "array": lambda: F.size(v), "set": lambda: F.size(v), "map": lambda: F.size(v)}
    q = sized[of]() if of in sized else v
    fits = lambda ok: v.isNull() | ok if skip and of in sized else ok
    if c.kind in ("min", "max"):
        n, inc = a["value"], a["inclusive"]
        said = size_message(c.kind, of, n, inc, False)
        ok = (q >= n if inc else q > n) if c.kind == "min" else (q <= n if inc else q < n)
        code, word = ("too_small", "minimum") if c.kind == "min" else ("too_big", "maximum")
        return [(fits(ok), lambda: say(code, said, **{word: n}, type=of, inclusive=inc, exact=False))]
    if c.kind == "length":
        n, out = a["value"], []
        for kind, code, word, ok in (("max", "too_big", "maximum", q <= n), ("min", "too_small", "minimum", q >= n)):
            said = size_message(kind, of, n, True, True)
            out.append((fits(ok), lambda code=code, word=word, said=said: say(code, said, **{word: n}, type=of, inclusive=True, exact=True)))
        return out
    if c.kind == "int":
        ok = (F.rint(v.cast("double")) == v) & (F.abs(v) < float("inf"))
        ok = ok & (F.abs(v) <= 9007199254740991) if opt.dialect == "v4" else ok
        return [(ok, lambda: say("invalid_type", "Expected integer, received float", expected="integer", received="float"))]
    if c.kind == "finite":
        return [(F.abs(v) < float("inf"), lambda: say("not_finite", "Number must be finite"))]
    if c.kind == "multiple_of":
        n = a["value"]
        ok = v % F.lit(n) == 0 if of == "bigint" else _whole(v, dtype, n)
        return [(ok, lambda: say("not_multiple_of", f"Number must be a multiple of {n}", multipleOf=n))]
    if c.kind in ("regex", "includes", "starts_with", "ends_with", "format"):
        if c.kind == "regex":
            ok, name, said = v.rlike(regexes.java(a["pattern"], a.get("flags", ""))), "regex", "Invalid"
        elif c.kind == "includes":
            ok = F.locate(a["part"], v, a["position"] + 1) > 0 if a["position"] else v.contains(a["part"])
            name, said = "includes", f'Invalid input: must include "{a["part"]}"'
        elif c.kind == "starts_with":
            ok, name, said = v.startswith(a["part"]), "startsWith", f'Invalid input: must start with "{a["part"]}"'
        elif c.kind == "ends_with":
            ok, name, said = v.endswith(a["part"]), "endsWith", f'Invalid input: must end with "{a["part"]}"'
        else:
            ok, name, said = _format(v, a["name"], a), a["name"], f"Invalid {a['name']}"
        return [(ok, lambda: say("invalid_string", said, validation=name))]
    if c.kind == "refine":
        return [(F.coalesce(a["f"](v), F.lit(False)), lambda: issue("custom", [*path, *[F.lit(p) for p in a["path"]]], "Invalid input", c.message, opt.maps))]
    if c.kind == "refine_udf":
        import pandas as pd  # noqa: F401

        return [(F.coalesce(F.pandas_udf(a["f"], "boolean")(v), F.lit(False)), lambda: issue("custom", path, "Invalid input", c.message, opt.maps))]
    raise UnsupportedInSpark(f"check {c.kind!r} on {of}")


_REWRITES = {"trim": lambda v: F.regexp_replace(v, rf"^{regexes.SPACE}+|{regexes.SPACE}+\z", ""), "lower": F.lower, "upper": F.upper}


#: Leaves whose ok is false wherever their value is null, and checks that are null on a null value only: there ok needs
#: no coalesce, which would keep the check from the scan.
_WRAPPERS = ("optional", "nullable", "default", "prefault", "catch", "readonly", "brand", "nonoptional", "lazy")
_LEAVES, _PLAIN = ("string", "number", "bigint", "date"), ("min", "max", "length", "regex", "includes", "starts_with", "ends_with")


def _fatal(found: Column) -> Column:
    return F.exists(found, lambda x: F.coalesce(x["params"]["fatal"] == "true", F.lit(False)))


def _checked(of: str, s: Schema, node: Node, opt: Options, path: list[Column], variant: bool) -> Node:
    """Checks run in order on the value; a failed check leaves the value in place (dirty), an aborting one ends the rest."""
    v, ok, dirty = node.value, node.ok, node.dirty
    bare = s.kind in _LEAVES and not variant
    skip = s.kind in _WRAPPERS
    steps: list[tuple[Column, Column | None, Callable[[], Column], bool, Column | None]] = []  # good, when, issues, many, ends the rest
    for c in s.checks:
        if c.kind in _REWRITES or c.kind == "overwrite":
            new = _REWRITES[c.kind](v) if c.kind in _REWRITES else c.args["f"](v)
            dirty = both(dirty, F.coalesce(~new.eqNullSafe(v), F.lit(False)))
            v, bare = new, bare and c.kind != "overwrite"
            continue
        ends, many = None, True
        if c.kind == "super_refine":
            found = F.coalesce(c.args["f"](v), none())
            parts, ends = [(F.size(found) == 0, lambda found=found: found)], _fatal(found)
        elif c.kind == "property":
            t = node.dtype[c.args["name"]].dataType
            child = lower(c.args["schema"], In(v[c.args["name"]], t, opt), [*path, F.lit(c.args["name"])])
            parts = [(child.ok, child.issues)]
        else:
            parts, many = _test(of, c, v, node.dtype, opt, path, skip), False
        for good, issue_of in parts:
            plain, good = good, F.coalesce(good, F.lit(False))
            when = None if c.when is None else F.coalesce(c.when(v), F.lit(False))
            ok = ok & (plain if bare and when is None and c.kind in _PLAIN else good if when is None else ~when | good)
            steps.append((good, when, issue_of, many, ~good if c.abort else ends))
        if c.kind == "super_refine" and c.args["value"] is not None:
            new = c.args["value"](v)
            dirty = both(dirty, F.coalesce(~new.eqNullSafe(v), F.lit(False)))
            v, bare = new, False

    def aborted() -> Column:
        ends = [e for *_, e in steps if e is not None]
        return reduce(lambda a, b: a | b, ends, node.aborted) if ends else node.aborted

    def issues() -> Column:
        own, go = [], ~node.aborted
        for good, when, f, many, ends in steps:
            bad = (go if when is None else go & when) & ~good
            own.append(F.when(bad, f() if many else F.array(f())).otherwise(none()))
            go = go if ends is None else go & ~ends
        return F.concat(node.issues(), *own) if own else node.issues()

    return Node(v, ok, issues, aborted, dirty, node.dtype)


def _string_of_number(x: Column) -> Column:
    """A double's text as JavaScript writes it."""
    size = F.abs(x)
    digits = lambda kind: F.regexp_replace(F.regexp_replace(x.cast(kind).cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    short = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.0)?E-", "e-"), r"(\.0)?E(?=\d)", "e+")
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when((F.rint(x) == x) & (size < 1e15), x.cast("long").cast("string"))
        .when((size >= 1e-6) & (size < 1e15), digits("decimal(38,22)")).when((size >= 1e15) & (size < 1e21), digits("decimal(38,6)")).otherwise(short)
    )


def _coerce(kind: str, i: In) -> In:
    x, t = i.x, i.dtype
    if i.variant:
        raise UnsupportedInSpark("coerce on VARIANT input: cast the column first")
    s, num, b = isinstance(t, T.StringType), isinstance(t, NUMBERS), isinstance(t, T.BooleanType)
    if kind == "string":
        y = x if s else _string_of_number(x.cast("double")) if num else x.cast("string")
        return In(F.coalesce(y, F.lit("undefined" if i.opt.null_means == "undefined" else "null")), T.StringType(), i.opt)
    if kind in ("number", "bigint"):
        to = "double" if kind == "number" else "decimal(38,0)"
        trimmed = F.regexp_replace(x.cast("string"), rf"^{regexes.SPACE}+|{regexes.SPACE}+\z", "")
        hexa = F.conv(F.substring(trimmed, 3, 20), 16, 10).try_cast(to)
        plain = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\z" if kind == "number" else r"^[+-]?\d+\z"
        from_text = F.when(trimmed == "", F.lit(0).cast(to)).when(trimmed.rlike(r"^0[xX][0-9a-fA-F]+\z"), hexa).when(trimmed.rlike(plain), trimmed.try_cast(to))
        if kind == "number":
            from_text = from_text.when(trimmed.isin("Infinity", "+Infinity"), float("inf")).when(trimmed == "-Infinity", float("-inf")).otherwise(float("nan"))
            y = F.when(x.isNotNull(), from_text) if s else F.unix_millis(x.cast("timestamp")).cast("double") if isinstance(t, T.TimestampType | T.DateType) else x.cast("double")
            y = F.coalesce(y, F.lit(float("nan") if i.opt.null_means == "undefined" else 0.0))
        else:
            y = F.when(x.isNotNull(), from_text) if s else x.try_cast(to)
        return In(y, T.DoubleType() if kind == "number" else T.DecimalType(38, 0), i.opt)
    if kind == "boolean":
        y = F.length(x) > 0 if s else (x != 0) & ~F.isnan(x.cast("double")) if num else x if b else x.isNotNull()
        return In(F.coalesce(y, F.lit(False)), T.BooleanType(), i.opt)
    y = x.try_cast("timestamp") if s else F.timestamp_millis(x.cast("long")) if num else x.cast("timestamp")
    return In(F.coalesce(y, F.timestamp_millis(F.lit(0)) if i.opt.null_means == "null" else y), T.TimestampType(), i.opt)


def _value_test(x_of: Callable[[str], tuple[Column, Column]], v) -> Column:
    kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string"
    is_, x = x_of(kind)
    same = F.isnan(x) if isinstance(v, float) and v != v else x == F.lit(v)
    return is_ & F.coalesce(same, F.lit(False))


def lower(s: Schema, i: In, path: list[Column]) -> Node:
    made = _LOWER.get(s.kind)
    if made is None:
        raise UnsupportedInSpark(f"schema kind {s.kind!r}")
    own = s.args.get("messages", {})
    quick = i.opt.quick and not s.checks
    if own or i.opt.own or quick != i.opt.quick:
        i = In(i.x, i.dtype, replace(i.opt, own=own, quick=quick), i.present)
    if s.args.get("coerce"):
        i = _coerce(s.kind, i)
    node = made(s, i, path)
    return _checked(_kind(s, node.dtype), s, node, i.opt, path, i.variant) if s.checks else node


_OF = {"tuple": "array", "record": "map", "discriminated": "object"}
_KINDS = ("string", "number", "bigint", "date", "array", "set", "map", "object")


def _kind(s: Schema, dtype: T.DataType) -> str:
    """What a schema's checks measure: its own kind, that of what it wraps, or else that of the values' type."""
    k = _OF.get(s.kind, s.kind)
    if k in _KINDS:
        return k
    if s.kind in _WRAPPERS or s.kind == "pipe":
        return _kind(s.args["out"] if s.kind == "pipe" else resolved(s) if s.kind == "lazy" else s.args["inner"], dtype)
    for name, kinds in (("string", T.StringType), ("number", NUMBERS), ("date", (T.TimestampType, T.DateType, T.TimestampNTZType)), ("array", T.ArrayType), ("map", T.MapType), ("object", T.StructType)):
        if isinstance(dtype, kinds):
            return name
    return k


def _basic(i: In, kind: str) -> tuple[Column, Column]:
    if kind == "string":
        return i.typed((T.StringType,), "string", "STRING")
    if kind == "boolean":
        return i.typed((T.BooleanType,), "boolean", "BOOLEAN")
    return i.typed(NUMBERS, "double", _NUM)


def _string(s, i, path):
    ok, v = _basic(i, "string")
    return _leaf("string", ok, v, T.StringType(), i, path)


def _number(s, i, path):
    ok, v = _basic(i, "number")
    if i.variant or isinstance(i.dtype, T.DoubleType | T.FloatType):
        ok = ok & (F.abs(v) < float("inf") if i.opt.dialect == "v4" else ~F.isnan(v))  # not-a-number is above infinity
    return _leaf("number", ok, v, T.DoubleType() if i.variant else i.dtype, i, path)


def _boolean(s, i, path):
    ok, v = _basic(i, "boolean")
    return _leaf("boolean", ok, v, T.BooleanType(), i, path)


def _bigint(s, i, path):
    if i.variant:
        return _leaf("bigint", F.lit(False), F.lit(None).cast("long"), T.LongType(), i, path)
    fits = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    whole = isinstance(i.dtype, fits) or (isinstance(i.dtype, T.DecimalType) and i.dtype.scale == 0)
    return _leaf("bigint", i.x.isNotNull() if whole else F.lit(False), i.x if whole else F.lit(None).cast("long"), i.dtype if whole else T.LongType(), i, path)


def _date(s, i, path):
    ok, v = i.typed((T.TimestampType, T.DateType, T.TimestampNTZType), "timestamp", "TIMESTAMP")
    said = (lambda: issue("invalid_date", path, "Invalid date", maps=i.opt.maps)) if s.args.get("coerce") else None
    return _leaf("date", ok, v, T.TimestampType() if i.variant else i.dtype, i, path, said)


def _null(s, i, path):
    return _leaf("null", i.null(), F.lit(None), T.NullType(), i, path)


def _undefined(s, i, path):
    return _leaf(s.kind, i.absent(), F.lit(None), T.NullType(), i, path)


def _any(s, i, path):
    return Node(i.x, F.lit(True), none, F.lit(False), None, i.dtype)


def _never(s, i, path):
    return _leaf("never", F.lit(False), i.x, i.dtype, i, path)


def _nan(s, i, path):
    ok = F.coalesce(F.isnan(i.x), F.lit(False)) if isinstance(i.dtype, T.DoubleType | T.FloatType) else F.lit(False)
    return _leaf("nan", ok, i.x, i.dtype, i, path)


def _symbol(s, i, path):
    raise UnsupportedInSpark("symbols have no Spark value")


def _literal(s, i, path):
    vs = s.args["values"]
    ok = reduce(lambda a, b: a | b, [i.null() if v is None else _value_test(lambda k: _basic(i, k), v) for v in vs])
    first = next((v for v in vs if v is not None), None)
    kind = "boolean" if isinstance(first, bool) else "number" if isinstance(first, int | float) else "string"
    one = i.variant and len({"boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" for v in vs if v is not None}) <= 1
    value = _basic(i, kind)[1] if one else i.x
    dtype = {"boolean": T.BooleanType(), "number": T.DoubleType(), "string": T.StringType()}[kind] if one else i.dtype
    said = lambda: issue("invalid_literal", path, f"Invalid literal value, expected {_quoted(vs[0])}", expected=_quoted(vs[0]), maps=i.opt.maps, received=i.received())
    return _leaf("literal", ok, value, dtype, i, path, said)


def _quoted(v) -> str:
    return f'"{v}"' if isinstance(v, str) else "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _enum(s, i, path):
    vs = s.args["values"]
    texts, nums = [v for v in vs if isinstance(v, str)], [v for v in vs if not isinstance(v, str)]
    tests = []
    if texts:
        is_, x = _basic(i, "string")
        tests.append(is_ & F.coalesce(x.isin(texts), F.lit(False)) if i.variant else x.isin(texts) if isinstance(i.dtype, T.StringType) else F.lit(False))
    if nums:
        is_, x = _basic(i, "number")
        tests.append(is_ & F.coalesce(x.isin(nums), F.lit(False)))
    ok = F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if nums or i.variant else tests[0] & i.x.isNotNull()
    (is_text, text), (is_num, num) = _basic(i, "string"), _basic(i, "number")
    x, given = text if texts else num, F.when(is_text, text).otherwise(_string_of_number(num.cast("double")))
    known = is_text | is_num if s.kind == "native_enum" else is_text if texts else is_num
    listed = " | ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in vs)
    said = lambda: F.when(known, issue("invalid_enum_value", path, F.concat(F.lit(f"Invalid enum value. Expected {listed}, received '"), given, F.lit("'")), maps=i.opt.maps, options=",".join(map(str, vs)), received=given)).otherwise(wrong_type(path, listed, i.received(), i.opt.maps))
    one = i.variant and not (texts and nums)
    return _leaf("enum", ok, x if one else i.x, (T.StringType() if texts else T.DoubleType()) if one else i.dtype, i, path, said)


def _unknown_keys(extra: Column, path: list[Column], opt: Options) -> Column:
    """The issue of extra keys, if there are any; a lambda's argument, so that they are looked for once."""
    said = lambda keys: F.concat(F.lit("Unrecognized key(s) in object: '"), F.array_join(keys, "', '"), F.lit("'"))
    return F.transform(F.filter(F.array(extra), lambda keys: F.size(keys) > 0), lambda keys: issue("unrecognized_keys", path, said(keys), maps=opt.maps, keys=F.array_join(keys, ",")))


def _object(s, i, path):
    shape, mode = s.args["shape"], s.args["mode"]
    if i.variant:
        held = F.try_variant_get(i.x, "$", "map<string,variant>")  # null for whatever is no object
        is_ = held.isNotNull()
        keys = F.map_keys(held)
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in shape]).cast("array<string>")) if shape else keys
        kids = {k: lower(n, In(F.try_variant_get(i.x, _json_path(k), "variant"), T.VariantType(), i.opt), [*path, F.lit(k)]) for k, n in shape.items()}
        more = F.coalesce(F.size(extra) > 0, F.lit(False))
        rest = F.map_filter(held, lambda k, _: ~k.isin(list(shape))) if shape else held
        rest_type: T.DataType | None = T.MapType(T.StringType(), T.VariantType())
    elif isinstance(i.dtype, T.StructType):
        is_, names = i.x.isNotNull(), i.dtype.names
        kids = {k: lower(n, In(i.x[k] if k in names else F.lit(None).cast("string"), i.dtype[k].dataType if k in names else T.StringType(), i.opt), [*path, F.lit(k)]) for k, n in shape.items()}
        left = [k for k in names if k not in shape]
        more = reduce(lambda a, b: a | b, [i.x[k].isNotNull() for k in left]) if left else F.lit(False)
        extra = F.filter(F.array(*[F.when(i.x[k].isNotNull(), F.lit(k)) for k in left]), lambda k: k.isNotNull()) if left else F.expr("cast(array() as array<string>)")
        rest = F.struct(*[i.x[k].alias(k) for k in left]) if left else None
        rest_type = T.StructType([i.dtype[k] for k in left]) if left else None
    else:
        return _leaf("object", F.lit(False), F.lit(None), T.NullType(), i, path)
    ok = all_of([is_, *[k.ok for k in kids.values()]])
    dirty = reduce(both, [k.dirty for k in kids.values()], None)
    pure = not i.variant and mode != "strict" and dirty is None and list(shape) == i.dtype.names and all(k.dtype == i.dtype[n].dataType for n, k in kids.items())
    fields = [k.value.alias(n) for n, k in kids.items()]
    types = [T.StructField(n, k.dtype) for n, k in kids.items()]
    extras: list[Callable[[], Column]] = []
    if mode == "strict":
        ok = ok & ~more
        extras.append(lambda: _unknown_keys(extra, path, i.opt))
    elif mode == "catchall" and i.variant:
        cells = _Cells(F.map_entries(rest), i.opt, lambda e, at, opt: [lower(s.args["catchall"], In(e["value"], T.VariantType(), opt), [*path, e["key"]])], lambda e, nodes: F.struct(e["key"].alias("key"), nodes[0].value.alias("value")))
        ok, dirty = ok & cells.ok(), both(dirty, cells.dirty())
        extras.append(lambda: F.coalesce(cells.issues(), none()))
        changed = not i.opt.quick and (cells.types[0] != T.VariantType() or _changes(s.args["catchall"]))
        fields.append((F.map_from_entries(cells.values()) if changed else rest).alias("_extras"))
        types.append(T.StructField("_extras", T.MapType(T.StringType(), cells.types[0])))
    elif mode == "catchall":  # the columns that the shape does not name
        others = {k: lower(s.args["catchall"], In(i.x[k], i.dtype[k].dataType, i.opt), [*path, F.lit(k)]) for k in left}
        there = {k: i.x[k].isNull() for k in left}
        ok = all_of([ok, *[there[k] | n.ok for k, n in others.items()]])
        dirty = reduce(both, [None if n.dirty is None else ~there[k] & n.dirty for k, n in others.items()], dirty)
        extras += [lambda k=k, n=n: F.when(there[k], none()).otherwise(n.issues()) for k, n in others.items()]
        if others:
            fields.append(F.struct(*[F.when(~there[k], n.value).alias(k) for k, n in others.items()]).alias("_extras"))
            types.append(T.StructField("_extras", T.StructType([T.StructField(k, n.dtype) for k, n in others.items()])))
    elif mode == "loose" and rest is not None:
        fields.append(rest.alias("_extras"))
        types.append(T.StructField("_extras", rest_type))
    elif mode == "strip":
        dirty = both(dirty, more) if i.variant or left else dirty
    if i.opt.quick:
        dirty = None if dirty is None else F.lit(False)
    value = i.x if pure or i.opt.quick else F.when(is_, F.struct(*fields)) if fields else i.x
    issues = lambda: F.when(is_, F.concat(*[k.issues() for k in kids.values()], *[e() for e in extras]) if kids or extras else none()).otherwise(F.array(wrong_type(path, "object", i.received(), i.opt.maps)))
    aborted = lambda: F.coalesce(reduce(lambda a, b: a | b, [k.aborted for k in kids.values()], ~is_), F.lit(True))
    return Node(value, F.coalesce(ok, F.lit(False)) if i.variant else ok, issues, aborted, None if dirty is None else F.coalesce(is_ & dirty, F.lit(False)), i.dtype if pure else T.StructType(types))


class _Cells:
    """The members of a container. lower_one(member, index, options) gives a member's nodes (a key and a value, say), built(member,
    nodes) the member that comes out. Each question lowers the member once."""

    def __init__(self, xs: Column, opt: Options, lower_one: Callable[[Column, Column, Options], list[Node]], built: Callable[[Column, list[Node]], Column], passes: Callable[[list[Node]], Column] | None = None):
        self.xs, self.lower_one, self.built = xs, lower_one, built
        self.asked, self.full, self.quick = opt, replace(opt, quick=False), replace(opt, quick=True)
        self.passes = passes or (lambda nodes: all_of([n.ok for n in nodes]))
        self._made: Column | None = None
        self._ok = F.forall(xs, self._first)

    def _first(self, e: Column) -> Column:
        nodes = self.lower_one(e, F.lit(0), self.quick)
        self.types, self.may_change = [n.dtype for n in nodes], any(n.dirty is not None for n in nodes)
        return self.passes(nodes)

    def ok(self) -> Column:
        return F.coalesce(self._ok, F.lit(False))

    def _both(self) -> Column:
        """value and dirty of every member"""
        if self._made is None:

            def one(e, at):
                nodes = self.lower_one(e, at, self.full)
                dirty = reduce(both, [n.dirty for n in nodes], None)
                return F.struct(self.built(e, nodes).alias("value"), (F.lit(False) if dirty is None else F.coalesce(dirty, F.lit(False))).alias("dirty"))

            self._made = F.transform(self.xs, one)
        return self._made

    def values(self) -> Column:
        if self.asked.quick:
            return self.xs
        return F.transform(self._both(), lambda c: c["value"])

    def dirty(self) -> Column | None:
        return None if not self.may_change else F.lit(False) if self.asked.quick else F.coalesce(F.exists(self._both(), lambda c: c["dirty"]), F.lit(False))

    def issues(self, of: Callable[[list[Node]], Column] | None = None) -> Column:
        said = of or (lambda nodes: F.concat(*[n.issues() for n in nodes]))
        return F.flatten(F.transform(self.xs, lambda e, at: said(self.lower_one(e, at, self.quick))))

    def aborted(self) -> Column:
        return F.coalesce(F.exists(self.xs, lambda e: reduce(lambda a, b: a | b, [n.aborted for n in self.lower_one(e, F.lit(0), self.quick)])), F.lit(False))


def _json_path(key: str) -> str:
    return f"$['{key}']" if not key.isidentifier() else f"$.{key}"


def _elements(i: In) -> tuple[Column, Column, T.DataType]:
    if i.variant:
        xs = F.try_variant_get(i.x, "$", "array<variant>")  # null for whatever is no array
        return xs.isNotNull(), xs, T.VariantType()
    if isinstance(i.dtype, T.ArrayType):
        return i.x.isNotNull(), i.x, i.dtype.elementType
    return F.lit(False), F.lit(None).cast("array<string>"), T.StringType()


def _distinct(xs: Column, t: T.DataType) -> Column:
    """Members that come again go; VARIANT has no equality of its own, so its JSON stands for it."""
    if not isinstance(t, T.VariantType):
        return F.array_distinct(xs)
    texts = F.transform(xs, lambda e: F.to_json(e))
    return F.transform(F.array_distinct(texts), lambda k: F.get(xs, (F.array_position(texts, k) - 1).cast("int")))


def _array(s, i, path, distinct=False):
    name = "set" if distinct else "array"
    is_, xs, t = _elements(i)
    cells = _Cells(xs, i.opt, lambda e, at, opt: [lower(s.args["element"], In(e, t, opt), [*path, at.cast("string")])], lambda e, nodes: nodes[0].value)
    pure = not i.variant and not cells.may_change and cells.types[0] == t and not _changes(s.args["element"])
    value, dirty = xs if pure else cells.values(), cells.dirty()
    if distinct and i.opt.quick:
        dirty = F.lit(False)
    elif distinct:
        new = _distinct(value, t if pure else cells.types[0])
        dirty = both(dirty, F.coalesce(F.size(new) < F.size(xs), F.lit(False)))
        value = new
    issues = lambda: F.when(is_, cells.issues()).otherwise(F.array(wrong_type(path, name, i.received(), i.opt.maps)))
    return Node(value, is_ & cells.ok(), issues, lambda: ~is_ | cells.aborted(), dirty, T.ArrayType(cells.types[0]))


def _changes(s: Schema) -> bool:
    """Whether a value may come out different."""
    made = ("default", "prefault", "catch", "transform", "transform_udf", "preprocess", "success", "set")
    rewrites = lambda c: c.kind in ("trim", "lower", "upper", "overwrite") or c.kind == "super_refine" and c.args["value"] is not None
    return any(x.kind in made or x.args.get("coerce") or any(map(rewrites, x.checks)) for x in walk(s))


def accepts_absence(s: Schema) -> bool:
    k = s.kind
    if k in ("optional", "default", "prefault", "catch", "undefined", "void", "any"):
        return True
    if k in ("nullable", "readonly", "brand", "transform", "pipe", "lazy"):
        return accepts_absence(resolved(s) if k == "lazy" else s.args["inner"])
    return any(map(accepts_absence, s.args["options"])) if k in ("union", "xor") else False


def _tuple(s, i, path):
    items, rest = s.args["items"], s.args["rest"]
    n, least = len(items), len(items)
    while least and accepts_absence(items[least - 1]):
        least -= 1
    if i.variant or isinstance(i.dtype, T.ArrayType):
        is_, xs, t = _elements(i)
        size = F.size(xs)
        kids = [lower(c, In(F.get(xs, F.lit(k)), t, i.opt), [*path, F.lit(str(k))]) for k, c in enumerate(items)]
        fits = (size >= least) & (F.lit(True) if rest else size <= n)
    elif isinstance(i.dtype, T.StructType):
        is_, xs = i.x.isNotNull(), None
        kids = [lower(c, In(i.x[i.dtype.names[k]], i.dtype[k].dataType, i.opt), [*path, F.lit(str(k))]) for k, c in enumerate(items)]
        fits, size = F.lit(len(i.dtype.names) >= least and (rest is not None or len(i.dtype.names) <= n)), F.lit(len(i.dtype.names))
    else:
        return _leaf("array", F.lit(False), F.lit(None), T.NullType(), i, path)
    ok, fields, types = all_of([is_, fits, *[k.ok for k in kids]]), [k.value.alias(f"_{j + 1}") for j, k in enumerate(kids)], [T.StructField(f"_{j + 1}", k.dtype) for j, k in enumerate(kids)]
    dirty = reduce(both, [k.dirty for k in kids], None)
    tail: Callable[[], Column] = none
    if rest is not None and xs is not None:
        behind = F.when(size > n, F.slice(xs, n + 1, F.greatest(size, F.lit(1)))).otherwise(F.slice(xs, 1, 0))
        cells = _Cells(behind, i.opt, lambda e, at, opt: [lower(rest, In(e, t, opt), [*path, (at + n).cast("string")])], lambda e, nodes: nodes[0].value)
        ok, tail = ok & cells.ok(), cells.issues
        fields.append(cells.values().alias("rest"))
        types.append(T.StructField("rest", T.ArrayType(cells.types[0])))
        dirty = both(dirty, cells.dirty())
    if least < n:  # the slots that come out: those given, and those behind them that the schema fills
        made = [F.when(k.value.isNotNull(), F.lit(j + 1)) for j, k in enumerate(kids) if j >= least and _shapes(k)]
        fields.append((F.greatest(F.least(size, F.lit(n)), F.lit(0), *made) + (F.greatest(size - n, F.lit(0)) if rest is not None else 0)).alias("_length"))
        types.append(T.StructField("_length", T.IntegerType()))
    small = lambda: F.array(issue("too_small", path, size_message("min", "array", n, True, False), maps=i.opt.maps, minimum=n, inclusive=True, exact=False, type="array"))
    big = lambda: F.when(size > n, F.array(issue("too_big", path, size_message("max", "array", n, True, False), maps=i.opt.maps, maximum=n, inclusive=True, exact=False, type="array"))).otherwise(none()) if rest is None else none()
    issues = lambda: F.when(~is_, F.array(wrong_type(path, "array", i.received(), i.opt.maps))).when(size < least, small()).otherwise(F.concat(big(), *[k.issues() for k in kids], tail()))
    return Node(F.when(is_, F.struct(*fields)), F.coalesce(ok, F.lit(False)), issues, ~is_ | F.coalesce(size < least, F.lit(False)), None if dirty is None else F.coalesce(dirty, F.lit(False)), T.StructType(types))


#: Keys that a record tries as numbers: JavaScript's texts of numbers
_NUMERIC_KEY = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _entries(s, i, path, kind):
    if i.variant and kind == "record":
        m, kt, vt = F.try_variant_get(i.x, "$", "map<string,variant>"), T.StringType(), T.VariantType()
        is_ = m.isNotNull()
    elif isinstance(i.dtype, T.MapType):
        is_, m, kt, vt = i.x.isNotNull(), i.x, i.dtype.keyType, i.dtype.valueType
    else:
        return _leaf("object" if kind == "record" else "map", F.lit(False), F.lit(None), T.NullType(), i, path)
    ks, vs, loose = s.args["key"], s.args["value"], s.args.get("loose", False)
    wrong = lambda: F.array(wrong_type(path, "object" if kind == "record" else "map", i.received(), i.opt.maps))
    if kind == "record" and ks.kind in ("enum", "literal") and not s.args.get("partial") and i.opt.dialect == "v4":  # every declared key, in order
        declared = list(ks.args["values"])
        kids = {k: lower(vs, In(F.try_element_at(m, F.lit(k)), vt, i.opt), [*path, F.lit(k)]) for k in declared}
        extra = F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in declared]))
        ok = all_of([is_, *[k.ok for k in kids.values()], *([] if loose else [F.size(extra) == 0])])
        value = F.map_from_arrays(F.array(*[F.lit(k) for k in declared]), F.array(*[k.value for k in kids.values()]))
        if loose:
            value = F.map_concat(value, F.map_filter(m, lambda k, _: ~k.isin(declared)))
        issues = lambda: F.when(is_, F.concat(*[k.issues() for k in kids.values()], none() if loose else _unknown_keys(extra, path, i.opt))).otherwise(wrong())
        dirty = reduce(both, [k.dirty for k in kids.values()], None)
        aborted = lambda: F.coalesce(reduce(lambda a, b: a | b, [k.aborted for k in kids.values()], ~is_), F.lit(True))
        return Node(value, F.coalesce(ok, F.lit(False)), issues, aborted, None if dirty is None else F.coalesce(dirty, F.lit(False)), T.MapType(kt, next(iter(kids.values())).dtype))
    where = (lambda e, at, w: [*path, e["key"].cast("string")]) if kind == "record" else (lambda e, at, w: [*path, at.cast("string"), F.lit(w)])

    def parts(e, at, opt) -> list[Node]:
        if kind == "record" and ks.kind == "number" and isinstance(kt, T.StringType):  # a key that reads as a number is tried as one
            at_key, reads = where(e, at, "key"), e["key"].rlike(_NUMERIC_KEY)
            num = lower(ks, In(F.when(reads, e["key"].try_cast("double")), T.DoubleType(), opt), at_key)
            said = lambda: F.when(reads, num.issues()).otherwise(F.array(wrong_type(at_key, "number", F.lit("string"), i.opt.maps)))
            k = Node(e["key"] if num.dirty is None else _string_of_number(num.value), reads & num.ok, said, lambda: ~reads | num.aborted, num.dirty, T.StringType())
        else:
            k = lower(ks, In(e["key"], kt, opt), where(e, at, "key"))
        return [k, lower(vs, In(e["value"], vt, opt), where(e, at, "value"))]

    def rebuilt(e, nodes):
        k, v = nodes
        if not loose:
            return F.struct(k.value.alias("key"), v.value.alias("value"))
        mine, other = (v.value, e["value"]) if v.dtype == vt else (_as_variant(v.value, v.dtype), _as_variant(e["value"], vt))
        return F.struct(F.when(k.ok, k.value).otherwise(e["key"]).alias("key"), F.when(k.ok, mine).otherwise(other).alias("value"))

    cells = _Cells(F.map_entries(m), i.opt, parts, rebuilt, (lambda nodes: ~nodes[0].ok | nodes[1].ok) if loose else None)
    if not i.opt.quick and (_changes(ks) or _changes(vs) or i.variant or cells.types != [kt, vt]):
        # a key that comes again keeps its first place and its last value
        pairs = F.array(cells.values())
        last = lambda ps, k: F.element_at(F.filter(ps, lambda e: e["key"] == k), -1)["value"]
        names = lambda ps: F.array_distinct(F.transform(ps, lambda e: e["key"]))
        once = lambda ps: F.size(names(ps)) == F.size(ps)
        value = F.get(F.transform(pairs, lambda ps: F.when(once(ps), F.map_from_entries(ps)).otherwise(F.map_from_arrays(names(ps), F.transform(names(ps), lambda k: last(ps, k))))), F.lit(0))
    else:
        value = m
    said = (lambda nodes: F.when(nodes[0].ok, nodes[1].issues()).otherwise(none())) if loose else None
    issues = lambda: F.when(is_, cells.issues(said)).otherwise(wrong())
    return Node(value, is_ & cells.ok(), issues, lambda: ~is_ | cells.aborted(), cells.dirty(), T.MapType(cells.types[0], T.VariantType() if loose and cells.types[1] != vt else cells.types[1]))


def _as_variant(x: Column, t: T.DataType) -> Column:
    return x if isinstance(t, T.VariantType) else F.to_variant_object(x) if isinstance(t, T.StructType | T.ArrayType | T.MapType) else x.cast("variant")


def _merged(nodes: list[Node]) -> tuple[list[Column], T.DataType]:
    """Values of one type: as they are if types agree, else VARIANT."""
    if all(n.dtype == nodes[0].dtype for n in nodes):
        return [n.value for n in nodes], nodes[0].dtype
    return [_as_variant(n.value, n.dtype) for n in nodes], T.VariantType()


def _union(s, i, path):
    opts = [lower(o, i, path) for o in s.args["options"]]
    values, t = _merged(opts)
    picks = [n.ok for n in opts]
    value = reduce(lambda acc, pv: acc.when(*pv), zip(picks[1:], values[1:], strict=True), F.when(picks[0], values[0]))
    ok = reduce(lambda a, b: a | b, picks)
    dirty = reduce(both, [None if n.dirty is None else n.ok & n.dirty for n in opts], None)

    def issues():
        out = F.when(ok, none())
        for n in opts:  # the first that only failed checks gives its own issues
            out = out.when(~n.aborted, n.issues())
        return out.otherwise(F.array(issue("invalid_union", path, "Invalid input", maps=i.opt.maps, unionErrors=F.to_json(F.array(*[n.issues() for n in opts])))))

    return Node(value, ok, issues, lambda: all_of([n.aborted for n in opts]), dirty, t)


def _xor(s, i, path):
    opts = [lower(o, i, path) for o in s.args["options"]]
    values, t = _merged(opts)
    n = sum((F.coalesce(o.ok, F.lit(False)).cast("int") for o in opts[1:]), F.coalesce(opts[0].ok, F.lit(False)).cast("int"))
    ok = n == 1
    value = reduce(lambda acc, pv: acc.when(*pv), zip([o.ok for o in opts[1:]], values[1:], strict=True), F.when(opts[0].ok, values[0]))
    return Node(F.when(ok, value), ok, lambda: F.when(ok, none()).otherwise(F.array(issue("invalid_union", path, "Invalid input", maps=i.opt.maps, matches=n))), ~ok, reduce(both, [None if o.dirty is None else o.ok & o.dirty for o in opts], None), t)


def tag_values(option: Schema, tag: str) -> tuple:
    """The values by which a discriminated union tells this option: a literal or an enum in an object."""
    field = resolved(option).args["shape"].get(tag) if resolved(option).kind == "object" else None
    if field is None or field.kind not in ("literal", "enum", "native_enum"):
        raise UnsupportedInSpark(f"an option of a discriminated union needs an object with a literal or an enum in {tag!r}, not {option.kind!r}")
    return field.args["values"]


def _discriminated(s, i, path):
    tag, opts = s.args["tag"], s.args["options"]
    if i.variant:
        read = In(F.try_variant_get(i.x, _json_path(tag), "variant"), T.VariantType(), i.opt)
        is_ = i.shape().startswith("OBJECT")
    elif isinstance(i.dtype, T.StructType):
        read, is_ = In(i.x[tag], i.dtype[tag].dataType, i.opt), i.x.isNotNull()
    else:
        return _leaf("object", F.lit(False), F.lit(None), T.NullType(), i, path)
    claimed: list = []
    hits, nodes = [], []
    for o in opts:
        vs = tag_values(o, tag)
        if set(vs) & set(claimed):
            raise ValueError(f"a value of {tag!r} is claimed twice")
        claimed += vs
        hits.append(reduce(lambda a, b: a | b, [read.null() if v is None else _value_test(lambda k: _basic(read, k), v) for v in vs]))
        nodes.append(lower(o, i, path))
    values, t = _merged(nodes)
    pick = lambda cols, other: reduce(lambda acc, hv: acc.when(*hv), zip(hits[1:], cols[1:], strict=True), F.when(hits[0], cols[0])).otherwise(other)
    ok = is_ & pick([n.ok for n in nodes], F.lit(False))
    said = ", ".join(f"'{v}'" for v in claimed).replace(", ", " | ")
    miss = lambda: F.array(issue("invalid_union_discriminator", [*path, F.lit(tag)], f"Invalid discriminator value. Expected {said}", maps=i.opt.maps, options=",".join(map(str, claimed))))
    issues = lambda: F.when(~is_, F.array(wrong_type(path, "object", i.received(), i.opt.maps))).otherwise(pick([n.issues() for n in nodes], miss()))
    dirty = None if all(n.dirty is None for n in nodes) else pick([F.lit(False) if n.dirty is None else n.dirty for n in nodes], F.lit(False))
    return Node(pick(values, F.lit(None).cast(t)), F.coalesce(ok, F.lit(False)), issues, lambda: F.coalesce(~is_ | pick([n.aborted for n in nodes], F.lit(True)), F.lit(True)), dirty, t)


def _intersection(s, i, path):
    a, b = lower(s.args["a"], i, path), lower(s.args["b"], i, path)
    value, t = b.value, b.dtype
    if isinstance(a.dtype, T.StructType) and isinstance(b.dtype, T.StructType):
        own = [f for f in a.dtype if f.name not in b.dtype.names]
        value, t = F.struct(*[a.value[f.name].alias(f.name) for f in own], *[b.value[f.name].alias(f.name) for f in b.dtype]), T.StructType([*own, *b.dtype])
    return Node(value, a.ok & b.ok, lambda: F.concat(a.issues(), b.issues()), lambda: a.aborted | b.aborted, both(a.dirty, b.dirty), t)


def _short(n: Node, skip: Column, dirty_too: bool = True) -> Node:
    """The inner node unless `skip`, then a plain null."""
    return Node(F.when(skip, F.lit(None).cast(n.dtype)).otherwise(n.value) if _shapes(n) else F.when(~skip, n.value), skip | n.ok, lambda: F.when(skip, none()).otherwise(n.issues()), lambda: ~skip & n.aborted, None if n.dirty is None else ~skip & n.dirty, n.dtype)


def _shapes(n: Node) -> bool:
    return not isinstance(n.dtype, T.NullType)


def _optional(s, i, path):
    inner = s.args["inner"]
    n = lower(inner, i, path)
    if i.opt.dialect == "v4" and inner.kind in ("default", "prefault"):  # the inner runs on an absent value; a failure answers absent
        skip = i.absent() & ~n.ok
        return _short(n, skip)
    if not i.variant and not _changes(inner) and n.dirty is None:
        skip = i.absent()
        return Node(n.value, skip | n.ok, lambda: F.when(skip, none()).otherwise(n.issues()), lambda: ~skip & n.aborted, None, n.dtype)
    return _short(n, i.absent())


def _nullable(s, i, path):
    n = lower(s.args["inner"], i, path)
    return _short(n, i.null())


def _constant(value, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.struct(*[_constant(value.get(f.name), f.dataType).alias(f.name) for f in t])
    if isinstance(t, T.ArrayType):
        return F.array(*[_constant(v, t.elementType) for v in value]).cast(t)
    if isinstance(t, T.MapType):
        return F.create_map(*[y for k, v in value.items() for y in (F.lit(k), _constant(v, t.valueType))]).cast(t)
    return F.lit(value).cast(t)


def _default(s, i, path):
    n = lower(s.args["inner"], i, path)
    d, gone = _constant(s.args["value"], n.dtype), i.absent()
    value = F.when(gone, d).otherwise(n.value)
    dirty = gone if n.dirty is None else gone | n.dirty
    if i.opt.dialect == "v3" and not i.variant:  # the default runs through the inner schema
        c = lower(s.args["inner"], In(d, i.dtype, i.opt), path)
        return Node(F.when(gone, c.value).otherwise(n.value), F.when(gone, c.ok).otherwise(n.ok), lambda: F.when(gone, c.issues()).otherwise(n.issues()), lambda: F.when(gone, c.aborted).otherwise(n.aborted), dirty, n.dtype)
    return Node(value, gone | n.ok, lambda: F.when(gone, none()).otherwise(n.issues()), lambda: ~gone & n.aborted, dirty, n.dtype)


def _prefault(s, i, path):
    gone = i.absent()
    if i.variant:
        import json

        x = F.coalesce(i.x, F.parse_json(F.lit(json.dumps(s.args["value"]))))
    else:
        x = F.coalesce(i.x, _constant(s.args["value"], i.dtype))
    n = lower(s.args["inner"], In(x, i.dtype, i.opt), path)
    return Node(n.value, n.ok, n.issues, lambda: n.aborted, both(gone, n.dirty), n.dtype)


def _catch(s, i, path):
    n = lower(s.args["inner"], i, path)
    v = s.args["value"]
    other = v(n.issues(), i.x) if callable(v) else _constant(v, n.dtype)
    good = F.coalesce(n.ok, F.lit(False))
    return Node(F.when(good, n.value).otherwise(other), F.lit(True), none, F.lit(False), ~good if n.dirty is None else ~good | n.dirty, n.dtype)


def _full(i: In) -> In:
    """The same input, where what comes out is asked for."""
    return In(i.x, i.dtype, replace(i.opt, quick=False), i.present) if i.opt.quick else i


def _transform(s, i, path):
    n = lower(s.args["inner"], _full(i), path)
    t = s.args["returns"]
    t = T._parse_datatype_string(t) if isinstance(t, str) else t or n.dtype
    return Node(F.when(n.ok, s.args["f"](n.value)), n.ok, n.issues, lambda: n.aborted | ~n.ok, n.ok, t)


def _preprocess(s, i, path):
    n = lower(s.args["inner"], In(s.args["f"](i.x), i.dtype, i.opt), path)
    return Node(n.value, n.ok, n.issues, lambda: n.aborted, both(n.dirty, ~n.value.eqNullSafe(i.x) if n.dtype == i.dtype and not isinstance(n.dtype, T.MapType | T.VariantType) else F.lit(True)), n.dtype)


def _pipe(s, i, path):
    a = lower(s.args["inner"], _full(i), path)
    b = lower(s.args["out"], In(a.value, a.dtype, i.opt), path)
    return Node(F.when(a.ok, b.value), a.ok & b.ok, lambda: F.when(a.ok, b.issues()).otherwise(a.issues()), lambda: a.aborted | ~a.ok | b.aborted, both(a.dirty, b.dirty), b.dtype)


def _through(s, i, path):
    return lower(s.args["inner"], i, path)


def _nonoptional(s, i, path):
    n, gone = lower(s.args["inner"], i, path), i.absent()
    return Node(n.value, ~gone & n.ok, lambda: F.when(gone, F.array(wrong_type(path, "nonoptional", i.received(), i.opt.maps))).otherwise(n.issues()), lambda: gone | n.aborted, n.dirty, n.dtype)


def _success(s, i, path):
    n = lower(s.args["inner"], i, path)
    return Node(F.coalesce(n.ok, F.lit(False)), F.lit(True), none, F.lit(False), F.lit(True), T.BooleanType())


#: As deep as Spark's own parser lets types and JSON be nested, about
_DEEPEST = 100


def _lazy(s, i, path):
    """Unrolled where it is asked for. The type of typed input ends that; a schema that asks for itself on one and the same
    value never ends, and VARIANT input has no type to end it: the interpreter takes those."""
    if len(path) > _DEEPEST or (i.variant and is_recursive(s)):
        raise UnsupportedInSpark("a recursive schema on VARIANT needs the interpreter tier")
    if i.opt.open.count(id(s.args["get"])) > _DEEPEST:
        raise UnsupportedInSpark("a lazy schema that is itself")
    return lower(resolved(s), In(i.x, i.dtype, replace(i.opt, open=(*i.opt.open, id(s.args["get"])))), path)


def _no_udf(s, i, path):
    raise UnsupportedInSpark("transform_udf needs the interpreter tier")


_LOWER = {
    "string": _string, "number": _number, "boolean": _boolean, "bigint": _bigint, "date": _date, "null": _null, "undefined": _undefined, "void": _undefined, "any": _any, "never": _never,
    "nan": _nan, "symbol": _symbol, "literal": _literal, "enum": _enum, "native_enum": _enum, "object": _object, "array": _array, "set": lambda s, i, p: _array(s, i, p, True), "tuple": _tuple,
    "record": lambda s, i, p: _entries(s, i, p, "record"), "map": lambda s, i, p: _entries(s, i, p, "map"), "union": _union, "xor": _xor, "discriminated": _discriminated, "intersection": _intersection,
    "optional": _optional, "nullable": _nullable, "default": _default, "prefault": _prefault, "catch": _catch, "transform": _transform, "preprocess": _preprocess, "pipe": _pipe,
    "readonly": _through, "brand": _through, "nonoptional": _nonoptional, "success": _success, "lazy": _lazy, "transform_udf": _no_udf,
}
