"""Issues as columns, and their default messages (fixed values)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colguard.nodes import UnsupportedInSpark

TYPE = "struct<code:string,path:array<string>,message:string,params:map<string,string>>"
NONE = f"cast(array() as array<{TYPE}>)"

#: What a message map holds for a code: a text in which {name} stands for a parameter, or a function of the parameters
#: (a dict of columns) and the message so far.
Message = str | Callable[[dict[str, Column], Column], Column]


def none() -> Column:
    return F.expr(NONE)


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, float) and value != int(value) else str(int(value)) if isinstance(value, float) else str(value))


def _mapped(messages: dict[str, Message], code: str, params: dict[str, Column], said: Column) -> Column:
    made = messages.get(code)
    if made is None:
        return said
    if not isinstance(made, str):
        return made(params, said)
    parts, rest = [], made
    for name in sorted(params, key=made.find):
        if (mark := "{" + name + "}") in rest:
            before, _, rest = rest.partition(mark)
            parts += [F.lit(before), F.coalesce(params[name], F.lit("null"))]
    return F.concat(*parts, F.lit(rest))


def issue(code: str, path: list[Column], message: str | Column, explicit: str | None = None, maps: tuple[dict[str, Message], ...] = (), **params) -> Column:
    """An issue's struct. An explicit message wins; otherwise each map in turn may replace the default `message`."""
    named = {k: text(v).cast("string") for k, v in params.items()}
    said = text(message).cast("string")
    for m in maps if explicit is None else ():
        said = _mapped(m, code, named, said)
    said = F.lit(explicit) if explicit is not None else said
    pairs = [y for k, v in named.items() for y in (F.lit(k), v)]
    p = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    where = F.array(*path).cast("array<string>") if path else F.expr("cast(array() as array<string>)")
    return F.struct(F.lit(code).alias("code"), where.alias("path"), said.alias("message"), p.alias("params")).cast(TYPE)


def wrong_type(path: list[Column], expected: str, received: Column, maps: tuple[dict[str, Message], ...] = ()) -> Column:
    said = F.when(received == "undefined", F.lit("Required")).otherwise(F.concat(F.lit(f"Expected {expected}, received "), received))
    return issue("invalid_type", path, said, maps=maps, expected=expected, received=received)


def joined(issues: Column) -> Column:
    """All issues of a value as one text, as an error shows them."""
    one = lambda i: F.concat(F.lit("["), i["code"], F.lit("] "), F.when(F.size(i["path"]) > 0, F.array_join(i["path"], ".")).otherwise("<root>"), F.lit(": "), F.coalesce(i["message"], F.lit("")))
    return F.when(F.size(issues) == 0, "Invalid input.").otherwise(F.array_join(F.transform(issues, one), "; "))


#: fixed values: what each kind of size check says; {} takes the bound
SAID = {
    ("min", "string"): ("at least", "over"), ("max", "string"): ("at most", "under"), ("min", "array"): ("at least", "more than"), ("max", "array"): ("at most", "less than"),
    ("min", "set"): ("at least", "more than"), ("max", "set"): ("at most", "less than"),
}
NAMES = {"string": "String", "array": "Array", "set": "Set", "map": "Map", "number": "Number", "bigint": "BigInt", "date": "Date"}


def size_message(kind: str, of: str, value, inclusive: bool, exact: bool) -> str:
    if of not in NAMES:
        raise UnsupportedInSpark(f"check {kind!r} on {of}")
    if of in ("string", "array", "set", "map"):
        how = "exactly" if exact else SAID.get((kind, of), ("at least" if kind == "min" else "at most",) * 2)[0 if inclusive else 1]
        return f"{NAMES[of]} must contain {how} {value} {'character' if of == 'string' else 'element'}(s)"
    how = ("greater than" if kind == "min" else "less than") + (" or equal to" if inclusive else "")
    return f"{NAMES[of]} must be {how} {value}"
