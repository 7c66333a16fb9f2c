"""Secret scans: keyword prefilter, anchored patterns near hits, embedded checksums.

One pass of an Aho-Corasick automaton over the text (ASCII letters lower-cased) finds keywords. Patterns are
only matched where a keyword ends, anchored there: assignments (`assign`), access keys (`access`), and the kinds
with a checksum: `github` (gh[pousr]_ and 36 base-62 characters) and `npm` (npm_ and 36), the last six of which
must be the CRC-32 of the rest in base 62; `card` (13 to 19 digits, blanks or hyphens between, within 24
characters behind the word card, visa, mastercard, amex or pan) under the Luhn sum; `iban` (within 8 characters
behind the word iban) under its remainder by 97. Runs of hexadecimal digits (`hex`) have no keyword and are found
by their pattern alone. Matches of a kind don't overlap, leftmost first; one that fails its length or checksum is
dropped but still takes its place. Spans are code points, end exclusive, in order of start, then kind.

Cases: a null or empty text has no span; very long texts are scanned whole; repeated rows give equal rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard.llm.common import slices

#: The kinds in the order they are listed, and the keywords that lead to each.
BASE = ["assign", "access", "hex"]
SLICE_BYTES = 8 << 20
KINDS = [*BASE, "github", "npm", "card", "iban"]
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "pan": "card", "iban": "iban",
}
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_CARD = re.compile(r"[^0-9]{0,24}?(?<![0-9])([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
_IBAN = re.compile(r"[^A-Za-z0-9]{0,8}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def token_checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0 and len(set(digits)) > 1


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Scanner:
    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.auto.add_word(word, (len(word), kind))
        self.auto.make_automaton()

    def _match(self, kind: str, text: str, start: int, end: int) -> tuple[int, int, bool] | None:
        """(start, end, whether it holds) of the match that this keyword leads to."""
        if kind == "assign":
            m = _ASSIGN.match(text, start)
            return m and (start, m.end(), len(m[1]) >= 6)
        if kind == "access":
            m = _ACCESS.match(text, start)
            return m and (start, m.end(), m.end() - start >= 20)
        if kind in ("github", "npm"):
            m = _TOKEN.match(text, start)
            return m and (start, m.end(), token_checksum(text[start + 4 : m.end() - 6]) == text[m.end() - 6 : m.end()])
        m = (_CARD if kind == "card" else _IBAN).match(text, end)
        if not m:
            return None
        return m.start(1), m.end(1), luhn(re.sub("[ -]", "", m[1])) if kind == "card" else iban(m[1])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, index of the kind, end) in order."""
        done, out = dict.fromkeys(KINDS, 0), []
        hits = sorted((i + 1 - n, i + 1, kind) for i, (n, kind) in self.auto.iter(text.translate(_UPPER)))
        for start, end, kind in hits:
            if kind in ("card", "iban"):
                if end < done[kind]:
                    continue
            elif start < done[kind]:
                continue
            if m := self._match(kind, text, start, end):
                if m[0] < done[kind]:
                    continue
                done[kind] = m[1]
                if m[2]:
                    out.append((m[0], KINDS.index(kind), m[1]))
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked."""
    out = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_checked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            rows = []
            for text in b.column("text").to_pylist():
                found = scanner.spans(text) if text else []
                n = [sum(k == i for _, k, _ in found) for i in range(3)]
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(x for x, (_, k, _) in zip(said, found, strict=True) if k < 3)
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(found) - sum(n)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, out, strict=True))], names=["doc_id", *out.names])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
