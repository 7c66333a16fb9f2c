"""String formats as Java patterns, and JavaScript patterns written as Java ones.

The formats are fixed values: they define what is accepted. JavaScript's final $ is \\z here.
"""

from __future__ import annotations

from functools import cache

from colguard.nodes import UnsupportedInSpark

#: JavaScript's white space, as the inside of a class (fixed value)
_SPACES = r"\t-\r\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{_SPACES}]"

#: Fixed values
_V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_V6 = r"(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}(:[0-9a-fA-F]{1,4}){1,1}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|([0-9a-fA-F]{1,4}:){1,1}(:[0-9a-fA-F]{1,4}){1,6}|:((:[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}|::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])|([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9]))"
_DATE = r"((\d\d[2468][048]|\d\d[13579][26]|\d\d0[48]|[02468][048]00|[13579][26]00)-02-29|\d{4}-((0[13578]|1[02])-(0[1-9]|[12]\d|3[01])|(0[469]|11)-(0[1-9]|[12]\d|30)|(02)-(0[1-9]|1\d|2[0-8])))"

FORMATS = {
    "email": r"(?i)^(?!\.)(?!.*\.\.)([A-Z0-9_'+\-\.]*)[A-Z0-9_+-]@([A-Z0-9][A-Z0-9\-]*\.)+[A-Z]{2,}\z",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    "cuid": rf"(?i)^c[^{_SPACES}-]{{8,}}\z",
    "cuid2": r"^[0-9a-z]+\z",
    "ulid": r"(?i)^[0-9A-HJKMNP-TV-Z]{26}\z",
    "nanoid": r"(?i)^[a-z0-9_-]{21}\z",
    "duration": r"^[-+]?P(?!\z)(?:(?:[-+]?\d+Y)|(?:[-+]?\d+[.,]\d+Y\z))?(?:(?:[-+]?\d+M)|(?:[-+]?\d+[.,]\d+M\z))?(?:(?:[-+]?\d+W)|(?:[-+]?\d+[.,]\d+W\z))?(?:(?:[-+]?\d+D)|(?:[-+]?\d+[.,]\d+D\z))?(?:T(?=[\d+-])(?:(?:[-+]?\d+H)|(?:[-+]?\d+[.,]\d+H\z))?(?:(?:[-+]?\d+M)|(?:[-+]?\d+[.,]\d+M\z))?(?:[-+]?\d+(?:[.,]\d+)?S)?)??\z",
    "date": rf"^{_DATE}\z",
    "base64": r"^([0-9a-zA-Z+/]{4})*(([0-9a-zA-Z+/]{2}==)|([0-9a-zA-Z+/]{3}=))?\z",
    "base64url": r"^([0-9a-zA-Z\-_]{4})*(([0-9a-zA-Z\-_]{2}(==)?)|([0-9a-zA-Z\-_]{3}(=)?))?\z",
    "ipv4": rf"^{_V4}\z",
    "ipv6": rf"^{_V6}\z",
    "cidrv4": rf"^{_V4}/(3[0-2]|[12]?[0-9])\z",
    "cidrv6": rf"^{_V6}/(12[0-8]|1[01][0-9]|[1-9]?[0-9])\z",
    "jwt": r"^[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*\z",
}


def url() -> str:
    """What a URL parser of the web takes, for a text without the blanks around it (domains are not checked as IDNA): of the
    special schemes, which need a host, http, https, ws, wss, ftp; files, whose host may be empty; and all others."""
    port = r"(?::0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?"
    six, char = rf"\[{_V6}\]", r"(?:[^\x00-\x20#/<>?@\[\\\]^|:%\x7F]|%(?!(?:[01][0-9a-fA-F]|2[0357fF]|3[aAcCeEfF]|40|5[bBcCdDeE]|7[cCfF]))[0-9a-fA-F]{2})"
    number = r"(?:[0-9]+|0[xX][0-9a-fA-F]*)"
    byte = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])|0[xX]0*[0-9a-fA-F]{0,2})"
    end, end_special = r"(?=[/?#]|\z)", r"(?=[/\\?#]|\z)"
    # a host whose last part is a number is an IPv4 address
    four = rf"(?:{byte}\.){{3}}{byte}\.?|(?:{byte}\.){{0,2}}{number}\.?"
    host = rf"(?:{six}|(?!(?:{char}+\.)?{number}\.?(?=[:/\\?#]|\z)){char}+|(?:{four})(?=[:/\\?#]|\z))"
    special = rf"(?i:https?|wss?|ftp):[/\\]*(?:[^/\\?#]*@)?{host}{port}{end_special}"
    file = rf"(?i:file):(?:[/\\]{{2}}(?:{six}|{char}*){end_special}|(?![/\\]{{2}}))"
    opaque = r"[^\x00\t\n\r #/:<>?@\[\\\]^|]*"
    other = rf"(?!(?i:https?|wss?|ftp|file):)[a-zA-Z][a-zA-Z0-9+.-]*:(?://(?:(?:[^/?#]*@)?(?:{six}|{opaque}){port}){end}|(?!//))"
    return rf"^(?:{special}|{file}|{other})"


#: What a URL parser takes away first: control characters and blanks at both ends, tabs and line ends everywhere
URL_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]"


@cache
def emoji() -> str:
    """Characters with the properties Extended_Pictographic or Emoji_Component, as ranges: Java 17 lacks the properties."""
    import regex

    has = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Component}]")
    held = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and has.match(chr(c))]
    first = [c for a, c in zip([-2, *held], held, strict=False) if c != a + 1]
    last = [a for a, c in zip(held, [*held[1:], -2], strict=True) if c != a + 1]
    return "^[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last, strict=True)) + r"]+\z"


def time(precision: int | None) -> str:
    """precision 0 allows no fraction, like the rule this follows."""
    fraction = rf"\.\d{{{precision}}}" if precision else "" if precision == 0 else r"(\.\d+)?"
    return rf"([01]\d|2[0-3]):[0-5]\d:[0-5]\d{fraction}"


def datetime(precision: int | None, offset: bool, local: bool) -> str:
    zone = "|".join(["Z?" if local else "Z", *([r"([+-]\d{2}:?\d{2})"] if offset else [])])
    return rf"^{_DATE}T{time(precision)}({zone})\z"


#: Line ends of JavaScript
_ENDS = r"\n\r\x{2028}\x{2029}"


def java(pattern: str, flags: str = "") -> str:
    """A JavaScript pattern with its flags (i, m, s, u; d, g change no test) as a Java one. What differs: $ and ^ (ends of the
    text, or of lines with m), the dot's line ends, white space of \\s, [^] and [], brackets and && in classes, \\u{...}."""
    if set(flags) - set("imsudg"):
        raise UnsupportedInSpark(f"regex flags {flags!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "\\" and i < len(pattern):
            c, i = pattern[i], i + 1
            if c == "s":
                out.append(_SPACES if inside else SPACE)
            elif c == "S":
                out.append(f"[^{_SPACES}]")
            elif c == "u" and pattern[i : i + 1] == "{":
                out.append("\\x")
            else:
                out.append("\\" + c)
        elif inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            if pattern[i : i + 2] == "^]":
                out.append(r"[\s\S]")
                i += 2
            elif pattern[i : i + 1] == "]":
                out.append("(?!)")
                i += 1
            else:
                inside = True
                out.append(c)
                if pattern[i : i + 1] == "^":
                    out.append("^")
                    i += 1
        elif c == "$":
            out.append(f"(?![^{_ENDS}])" if "m" in flags else r"\z")
        elif c == "^" and "m" in flags:
            out.append(f"(?<![^{_ENDS}])")
        elif c == ".":
            out.append(r"[\s\S]" if "s" in flags else f"[^{_ENDS}]")
        else:
            out.append(c)
    return ("(?iu)" if "i" in flags and "u" in flags else "(?i)" if "i" in flags else "") + "".join(out)
