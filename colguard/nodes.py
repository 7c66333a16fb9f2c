"""Schemas: immutable trees, built by functions and changed by methods that return a new node."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


class UnsupportedInSpark(Exception):
    """A schema that has no Spark meaning; raised at compile time."""


@dataclass(frozen=True)
class Check:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)
    message: str | None = None
    abort: bool = False
    when: Callable | None = None


@dataclass(frozen=True)
class Schema:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()

    def check(self, kind: str, message: str | None = None, abort: bool = False, when: Callable | None = None, **args: Any) -> Schema:
        return replace(self, checks=(*self.checks, Check(kind, args, message, abort, when)))

    def _wrap(self, kind: str, **args: Any) -> Schema:
        return Schema(kind, {"inner": self, **args})

    # lengths and ranges
    def min(self, n, message=None):
        return self.check("min", message, value=n, inclusive=True)

    def max(self, n, message=None):
        return self.check("max", message, value=n, inclusive=True)

    def gt(self, n, message=None):
        return self.check("min", message, value=n, inclusive=False)

    def lt(self, n, message=None):
        return self.check("max", message, value=n, inclusive=False)

    gte, lte = min, max

    def length(self, n, message=None):
        return self.check("length", message, value=n)

    size = length

    def nonempty(self, message=None):
        return self.min(1, message)

    def int(self, message=None):
        return self.check("int", message)

    def finite(self, message=None):
        return self.check("finite", message)

    def multiple_of(self, n, message=None):
        return self.check("multiple_of", message, value=n)

    def positive(self):
        return self.gt(0)

    def nonnegative(self):
        return self.min(0)

    def negative(self):
        return self.lt(0)

    # strings
    def regex(self, pattern, message=None, flags=""):
        """A JavaScript pattern and its flags."""
        return self.check("regex", message, pattern=pattern, flags=flags)

    def includes(self, part, position=0, message=None):
        return self.check("includes", message, part=part, position=position)

    def starts_with(self, part, message=None):
        return self.check("starts_with", message, part=part)

    def ends_with(self, part, message=None):
        return self.check("ends_with", message, part=part)

    def format(self, name, message=None, **args):
        return self.check("format", message, name=name, **args)

    def email(self):
        return self.format("email")

    def url(self):
        return self.format("url")

    def uuid(self):
        return self.format("uuid")

    def trim(self):
        return self.check("trim")

    def lower(self):
        return self.check("lower")

    def upper(self):
        return self.check("upper")

    def overwrite(self, f):
        return self.check("overwrite", f=f)

    # objects
    def strict(self):
        return replace(self, args={**self.args, "mode": "strict"})

    def loose(self):
        return replace(self, args={**self.args, "mode": "loose"})

    def strip(self):
        return replace(self, args={**self.args, "mode": "strip"})

    def catchall(self, schema):
        return replace(self, args={**self.args, "mode": "catchall", "catchall": schema})

    def property(self, name, schema):
        return self.check("property", name=name, schema=schema)

    # wrappers
    def optional(self):
        return self._wrap("optional")

    exact_optional = optional

    def nullable(self):
        return self._wrap("nullable")

    def nullish(self):
        return self.nullable().optional()

    def default(self, value):
        return self._wrap("default", value=value)

    def prefault(self, value):
        return self._wrap("prefault", value=value)

    def catch(self, value):
        return self._wrap("catch", value=value)

    def transform(self, f, returns=None):
        return self._wrap("transform", f=f, returns=returns)

    def pipe(self, other):
        return self._wrap("pipe", out=other)

    def readonly(self):
        return self._wrap("readonly")

    def brand(self, _name=None):
        return self._wrap("brand")

    def nonoptional(self):
        return self._wrap("nonoptional")

    def success(self):
        return self._wrap("success")

    # callbacks
    def refine(self, f, message=None, abort=False, when=None, path=()):
        return self.check("refine", message, abort, when, f=f, path=tuple(path))

    def super_refine(self, f, value=None):
        """f(value) gives an array column of issues: struct(code, path, message, params), see issues.issue; an issue with
        the parameter fatal = true ends the checks behind. value: a function that gives the value its new form."""
        return self.check("super_refine", f=f, value=value)

    def refine_udf(self, f, message=None):
        """f: pandas Series of values -> Series of booleans, called for a batch of rows at once, also below containers."""
        return self.check("refine_udf", message, f=f)

    def transform_udf(self, f, returns=None):
        """f: pandas Series of values -> Series of new values (what JSON holds; of the type `returns` at the top)."""
        return self._wrap("transform_udf", f=f, returns=returns)

    def messages(self, said: dict):
        """Default messages of this schema's own issues by code: texts in which {name} stands for a parameter, or
        functions of the parameters and the message so far. An explicit message of a check goes before."""
        return replace(self, args={**self.args, "messages": said})


def string(coerce=False):
    return Schema("string", {"coerce": coerce})


def string_format(name, test):
    """A format of one's own: test is a JavaScript pattern, or a function of the string's column that gives a boolean one."""
    return string().check("format", name=name, test=test)


def number(coerce=False):
    return Schema("number", {"coerce": coerce})


def boolean(coerce=False):
    return Schema("boolean", {"coerce": coerce})


def bigint(coerce=False):
    return Schema("bigint", {"coerce": coerce})


def date(coerce=False):
    return Schema("date", {"coerce": coerce})


def null():
    return Schema("null")


def undefined():
    return Schema("undefined")


def void():
    return Schema("void")


def any_():
    return Schema("any")


unknown = any_


def never():
    return Schema("never")


def nan():
    return Schema("nan")


def symbol():
    return Schema("symbol")


def custom(f, message=None):
    return any_().refine(f, message, abort=True)


def literal(*values):
    return Schema("literal", {"values": values})


def enum(*values):
    return Schema("enum", {"values": values})


def native_enum(members: dict):
    """String and number values; a number member's reverse entry (its name under its value) is no value."""
    return Schema("native_enum", {"values": tuple(v for k, v in members.items() if not isinstance(members.get(str(v)) if not isinstance(v, str) else members.get(v), int | float) or not isinstance(v, str))})


def object_(shape: dict[str, Schema], mode="strip"):
    return Schema("object", {"shape": shape, "mode": mode})


def array(element: Schema):
    return Schema("array", {"element": element})


def tuple_(*items: Schema, rest: Schema | None = None):
    return Schema("tuple", {"items": items, "rest": rest})


def record(key: Schema, value: Schema, loose=False, partial=False):
    return Schema("record", {"key": key, "value": value, "loose": loose, "partial": partial})


def map_(key: Schema, value: Schema):
    return Schema("map", {"key": key, "value": value})


def set_(element: Schema):
    return Schema("set", {"element": element})


def union(*options: Schema):
    return Schema("union", {"options": options})


def xor(*options: Schema):
    return Schema("xor", {"options": options})


def discriminated_union(tag: str, *options: Schema):
    return Schema("discriminated", {"tag": tag, "options": options})


def intersection(a: Schema, b: Schema):
    return Schema("intersection", {"a": a, "b": b})


def preprocess(f, inner: Schema):
    return Schema("preprocess", {"f": f, "inner": inner})


def codec(a: Schema, b: Schema, decode, returns=None):
    """decode: a's value to what b takes, of the type `returns`."""
    return a.transform(decode, returns).pipe(b)


def lazy(get: Callable[[], Schema]):
    """A schema that may hold itself; get is called when it is needed. Typed input ends it where its type ends; VARIANT
    input of any depth goes through the interpreter."""
    return Schema("lazy", {"get": get})


def children(s: Schema) -> list[Schema]:
    """The schemas that this one is made of; what a lazy one stands for is asked for by resolved()."""
    if s.kind == "lazy":
        return []
    out = []
    for v in s.args.values():
        out += [v] if isinstance(v, Schema) else [x for x in v.values() if isinstance(x, Schema)] if isinstance(v, dict) else [x for x in v if isinstance(x, Schema)] if isinstance(v, tuple | list) else []
    return out + [c.args["schema"] for c in s.checks if c.kind == "property"]


def resolved(s: Schema) -> Schema:
    """What a lazy schema stands for; its getter is called once."""
    if s.kind != "lazy":
        return s
    if "made" not in s.args:
        s.args["made"] = s.args["get"]()
    return s.args["made"]


def walk(s: Schema, seen: dict | None = None):
    """All schemas below s, s first, each lazy getter followed once."""
    seen = {} if seen is None else seen
    key = s.args["get"] if s.kind == "lazy" else s
    if id(key) in seen:
        return
    seen[id(key)] = key
    yield s
    for x in [resolved(s)] if s.kind == "lazy" else children(s):
        yield from walk(x, seen)


def is_recursive(s: Schema) -> bool:
    """Whether some lazy schema holds itself."""

    def holds(x: Schema, open_: frozenset) -> bool:
        if x.kind == "lazy":
            if id(x.args["get"]) in open_:
                return True
            return holds(resolved(x), open_ | {id(x.args["get"])})
        return any(holds(c, open_) for c in children(x))

    return holds(s, frozenset())
