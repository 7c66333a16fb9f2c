"""compile(schema, input) -> Compiled: validate, parse, safe_parse, split on DataFrames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colguard import interpreter
from colguard.issues import Message, joined
from colguard.lower import In, Node, Options, _changes, accepts_absence, lower
from colguard.nodes import Schema, children, is_recursive, resolved, walk

TIERS = ("auto", "columns", "interpreter")


class Compiled:
    """A schema bound to an input type. An object schema over a StructType is read from the DataFrame's own columns."""

    def __init__(self, schema: Schema, dtype: T.DataType, column: str | None, options: Options, tier: str):
        self.schema, self.dtype, self.column, self.options, self.tier = schema, dtype, column, options, tier

    def node(self, x: Column | None = None) -> Node:
        if self.tier == "interpreter":
            return self._interpreted(x)
        if x is None and self.column is None:
            return _row(self.schema, self.dtype, self.options)
        return lower(self.schema, In(F.col(self.column) if x is None else x, self.dtype, self.options), [])

    def _interpreted(self, x: Column | None) -> Node:
        if x is None:
            x = F.col(self.column) if self.column else F.struct(*[F.col(f"`{n}`").alias(n) for n in self.dtype.names])
        value, ok, dirty, issues = interpreter.columns(self.schema, x, self.dtype, self.options.dialect, self.options.null_means, self.options.messages)
        dtype = self.dtype
        if isinstance(dtype, T.VariantType) or _changes(self.schema) or any(s.kind in ("tuple", "success") for s in walk(self.schema)):
            dtype = T.VariantType()
        else:
            dtype = _kept(self.schema, dtype)
            value = F.try_variant_get(value, "$", dtype.simpleString())
        return Node(value, ok, lambda: issues, ~ok, dirty, dtype)

    @property
    def pure(self) -> bool:
        """Whether a value that passes always comes out as it went in; in v3 by the schema alone."""
        if self.options.dialect == "v3":
            return static_pure(self.schema)
        return self.tier == "columns" and self.node().dirty is None and not _changes(self.schema)

    @property
    def uses_python(self) -> bool:
        return self.tier == "interpreter" or any(c.kind == "refine_udf" for s in walk(self.schema) for c in s.checks)

    @property
    def recursive(self) -> bool:
        return is_recursive(self.schema)

    def validate(self, df: DataFrame) -> DataFrame:
        """v4: the rows that pass, untouched. v3: the same as parse()."""
        return self.parse(df) if self.options.dialect == "v3" else df.where(self.node().ok)

    def safe_parse(self, df: DataFrame) -> DataFrame:
        """All rows with success, data, issues and dirty added."""
        n = self.node()
        # ok is a column of its own, made once; the others ask for it
        rows = df.select("*", F.coalesce(n.ok, F.lit(False)).alias("__ok"))
        ok = F.col("__ok")
        dirty = F.lit(False) if n.dirty is None else F.coalesce(n.dirty, F.lit(False))
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], ok.alias("success"), F.when(ok, n.value).alias("data"), F.when(~ok, n.issues()).alias("issues"), (ok & dirty).alias("dirty"))

    def parse(self, df: DataFrame) -> DataFrame:
        """All rows with data added; a row that fails fails the job with its issues."""
        n = self.node()
        bad = F.raise_error(joined(n.issues())).cast(n.dtype)
        return df.select("*", F.when(n.ok, n.value).otherwise(bad).alias("data"))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = self.safe_parse(df)
        return done.where("success"), done.where("NOT success")

    def errors(self, df: DataFrame) -> DataFrame:
        """All rows with error added: the joined issues of a row that fails, else null."""
        done = self.safe_parse(df)
        return done.select(*[F.col(f"`{c}`") for c in df.columns], F.when(~F.col("success"), joined(F.col("issues"))).alias("error"))

    def report(self, df: DataFrame) -> DataFrame:
        """code, path, n: how often each issue comes (an extension)."""
        found = self.safe_parse(df).where("NOT success").select(F.explode("issues").alias("i"))
        return found.groupBy(F.col("i.code").alias("code"), F.array_join("i.path", ".").alias("path")).agg(F.count("*").alias("n"))

    def explain(self) -> dict[str, str]:
        n = self.node()
        return {"value": str(n.value), "ok": str(n.ok), "dirty": str(n.dirty), "issues": str(n.issues())}

    def code(self, df: DataFrame) -> dict[str, str]:
        """The SQL text of the columns over df, as Spark has resolved them."""
        n = self.node()
        made = {"value": n.value, "ok": n.ok, "issues": n.issues()} | ({} if n.dirty is None else {"dirty": n.dirty})
        found = df.select(*[c.alias(k) for k, c in made.items()])._jdf.queryExecution().analyzed().expressions()
        return {k: found.apply(j).child().sql() for j, k in enumerate(made)}

    safe_parse_async, parse_async = safe_parse, parse


def _kept(s: Schema, t: T.DataType) -> T.DataType:
    """The part of a type that a schema without rewrites keeps."""
    if s.kind == "object" and isinstance(t, T.StructType):
        named = [T.StructField(k, _kept(n, t[k].dataType)) for k, n in s.args["shape"].items() if k in t.names]
        left = [f for f in t if f.name not in s.args["shape"]] if s.args["mode"] in ("loose", "catchall") else []
        return T.StructType([*named, *([T.StructField("_extras", T.StructType(left))] if left else [])])
    if s.kind in ("array", "set") and isinstance(t, T.ArrayType):
        return T.ArrayType(_kept(s.args["element"], t.elementType))
    if s.kind in ("record", "map") and isinstance(t, T.MapType):
        return T.MapType(t.keyType, _kept(s.args["value"], t.valueType))
    if s.kind == "lazy":
        return _kept(resolved(s), t)
    return _kept(s.args["inner"], t) if "inner" in s.args else t


def static_pure(s: Schema, seen: frozenset = frozenset()) -> bool:
    """v3's purity: no part of the schema can make a value that is not the input's own. A strip counts as pure; a schema
    that holds itself counts as pure where it comes again."""
    if s.kind == "lazy":
        return id(s.args["get"]) in seen or static_pure(resolved(s), seen | {id(s.args["get"])})
    if s.args.get("coerce") or any(c.kind in ("trim", "lower", "upper", "overwrite") for c in s.checks):
        return False
    if s.kind in ("tuple", "default", "prefault", "catch", "transform", "transform_udf", "preprocess", "success", "intersection"):
        return False
    if s.kind == "array" and accepts_absence(s.args["element"]):
        return False
    if s.kind == "readonly" and children(s)[0].kind in ("object", "array", "tuple", "record", "map", "set"):
        return False
    return all(static_pure(c, seen) for c in children(s))


def absence_stable(s: Schema, seen: frozenset = frozenset()) -> bool:
    """Whether an absent value always passes and stays absent, told by the schema alone."""
    if s.kind in ("optional", "any", "undefined", "void"):
        return True
    if s.kind in ("nullable", "brand"):
        return absence_stable(s.args["inner"], seen)
    return s.kind == "union" and all(absence_stable(o, seen) for o in s.args["options"])


def _row(schema: Schema, dtype: T.StructType, options: Options) -> Node:
    """An object over the row itself: fields are plain columns, so checks on them can reach the scan."""
    whole = F.struct(*[F.col(f"`{n}`").alias(n) for n in dtype.names])

    class Row:
        def __getitem__(self, k):
            return F.col(f"`{k}`")

        def isNotNull(self):  # noqa: N802
            return F.lit(True)

        def isNull(self):  # noqa: N802
            return F.lit(False)

    n = lower(schema, In(Row(), dtype, options), [])  # type: ignore[arg-type]
    if isinstance(n.value, Row):
        n.value = whole
    return n


def compile(  # noqa: A001
    schema: Schema, source: DataFrame | T.DataType, column: str | None = None, dialect: str = "v4", null_means: str = "undefined", tier: str = "auto", messages: dict[str, Message] | None = None, **unknown
) -> Compiled:
    """source: the DataFrame or its type. column: the column that holds the values; without it each row is one value.
    messages: default messages by code, see nodes.Schema.messages. tier: "auto" takes columns where they can do."""
    if unknown:
        raise TypeError(f"unknown option {', '.join(unknown)}")
    if dialect not in ("v3", "v4") or null_means not in ("undefined", "null") or tier not in TIERS:
        raise TypeError("dialect is 'v3' or 'v4', null_means is 'undefined' or 'null', tier is one of " + ", ".join(TIERS))
    dtype = source.schema if isinstance(source, DataFrame) else source
    if column is not None and isinstance(dtype, T.StructType):
        dtype = dtype[column].dataType
    if tier == "auto":
        tier = "interpreter" if interpreter.needed(schema, _holds_variant(dtype), is_recursive(schema)) else "columns"
    return Compiled(schema, dtype, column, Options(dialect, null_means, messages or {}), tier)


def _holds_variant(t: T.DataType) -> bool:
    inner = [f.dataType for f in t] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else [t.valueType] if isinstance(t, T.MapType) else []
    return isinstance(t, T.VariantType) or any(map(_holds_variant, inner))


def check_count(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """n and ok: the check on the number of rows that an array of rows would have."""
    n = F.col("n")
    ok = (F.lit(True) if least is None else n >= least) & (F.lit(True) if most is None else n <= most)
    return df.agg(F.count("*").alias("n")).select("n", ok.alias("ok"))
