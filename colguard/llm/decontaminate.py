"""Benchmark decontamination by CGK walks, bit sampling and edit distance.

Text and benchmark items are lower-cased and read as words (ASCII white space between), joined by single blanks. An
item leaks into a document if some stretch of the document is within an edit distance of `share` of the item's
characters (by default one tenth, rounded down).

Windows: a window of an item's size is begun wherever an item could begin. An item with k edits allowed is cut into
pieces of about PIECE characters, k + 1 at least; k edits touch at most k of them, so any stretch within the distance
holds all others unchanged, each at most k characters from its place. The first PIECE characters of each piece are looked
up at every character of every document by hash; where enough of an item's pieces say about the same beginning, each of
them says where a window begins and how long it is. No stretch within the distance is without a window.
Candidates: each window is embedded by WALKS random walks (CGK: step j gives out the character under a pointer, and a
random bit of j and that character says whether the pointer moves on), which carry edit distance to Hamming distance:
after an edit, two walks fall in step again and then agree. Of each walk, SPAN places at each of the steps in
SPANS are sampled, as far as the window goes (its end excepted). A window whose sample equals an item's, for any walk
and span, is a candidate for that item. Items of fewer than SHORT characters hold too few spans: every window of theirs
is a candidate. Measured recall (tests): 0.9 at least for edits in 1 to 10 % of the characters, spread or in one place.
Verification: candidates whose surroundings hold too few of the item's runs of GRAM characters for any stretch within
the distance go (no match is lost); for the others, bit-parallel edit distance of the whole item against the document's
characters around the place.

Items are taken in blocks of at most BLOCK_BYTES of text (on average, dealt by hash), each block's index is sent to
the executors, and all documents meet every block; one block is the usual case.

Cases: an item of fewer than LEAST_WORDS words is no passage; it leaks into a document that has no other words; null
and empty items and texts never match; equal items each match; very long texts are searched whole; repeated rows each
match; empty tables give empty results; other columns are not read (leaks) or pass (clean).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard.llm.common import mix64, slices, union_all

LEAST_WORDS, BLOCK_BYTES = 5, 4 << 20
PIECE, GRAM, SLICE_BYTES = 9, 6, 8 << 20
WALKS, SPAN, SHORT = 6, 16, 40
#: first steps of the spans: in a row at first, then each half as far again, up to about 6,000 characters of a window
SPANS = (0, 16, 32, 48, 72, 108, 160, 240, 360, 540, 800, 1200, 1800, 2700, 4000, 6000, 9000)


def _normal(texts: pa.Array) -> list[str]:
    """Lower-cased, words joined by single blanks; null is empty."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)), pa.scalar(" ", pa.large_string())).to_pylist()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(c: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size, in rising order, 32-bit hashes of the runs of so many characters at each place."""
    out, h = {}, np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(max(sizes)):
            n = max(0, len(c) - j)
            h = h[:n] * np.uint32(0x9E3779B1)
            h += c[j : j + n]
            if j + 1 in sizes:
                x = h ^ h >> np.uint32(15)
                x *= np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
                out[j + 1] = x
    return out


def _grams(text: str) -> np.ndarray:
    """16-bit hashes of the text's runs of GRAM characters."""
    c = _codes(text)
    h = np.zeros(max(0, len(c) - GRAM + 1), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.uint32(0x9E3779B1) + c[j : j + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(16)).astype(np.uint16)


def _least(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the first end of such a stretch (Myers' bit vectors)."""
    m = len(pattern)
    if not m:
        return 0, 0
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, d, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        if d < best:
            best, end = d, i + 1
            if not best:
                break
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best, end


def edit_distance_within(pattern: str, text: str, most: int) -> int | None:
    """Least edit distance of the pattern to any stretch of the text, if not above `most`."""
    best, _ = _least(pattern, text)
    return best if best <= most else None


def _begin(pattern: str, text: str) -> int:
    """Where a stretch of the text with the least edit distance begins: the first end, then back."""
    _, end = _least(pattern, text)
    return end - _least(pattern[::-1], text[:end][::-1])[1]


def pieces(length: int, most: int) -> tuple[int, np.ndarray]:
    """Characters of a seed, and the first characters of the pieces of an item of `length` characters, most + 1 at least."""
    n = max(most + 1, length // PIECE)
    return min(PIECE, length // n), np.arange(n) * length // n


@cache
def _moves(walk: int, block: int) -> np.ndarray:
    """[step, character class] of 512 steps: whether the pointer moves on; class 0, a text's end, is never passed."""
    n = 512 * 256
    out = (mix64(np.arange(n, dtype=np.uint64) + np.uint64((1 << 40) + (walk << 32) + block * n)) >> np.uint64(63)).astype(np.uint8).reshape(512, 256)
    out[:, 0] = 0
    return out


def _classes(c: np.ndarray) -> np.ndarray:
    """Characters folded to 1 to 255; the line break, which ends a text, is 0."""
    return np.where(c == 10, 0, 1 + (c ^ c >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def spans_of(length: np.ndarray) -> np.ndarray:
    """How many spans a window of `length` characters has: a walk takes two steps a character, and the last fifth,
    where text behind the item comes in, is left out."""
    return np.searchsorted(np.array(SPANS) + SPAN, 8 * length // 5, side="right")


def samples(classes: np.ndarray, begin: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that begin at these places of a text (classes, 0 at the end) and have so many spans: hashes of the
    walk, span and sampled characters, and the window of each."""
    order = np.argsort(-spans, kind="stable")
    alive = np.searchsorted(-spans[order], -np.arange(1, len(SPANS) + 1), side="right")  # windows that have each span
    keys, window = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for w in range(WALKS):
            at, step = begin[order], 0
            for k, first in enumerate(SPANS):
                n = int(alive[k])
                if not n:
                    break
                at = at[:n]
                held = np.full(n, 1 + w * len(SPANS) + k, np.uint64)
                for j in range(step, first + SPAN):
                    c = classes[at]
                    if j >= first:
                        held *= np.uint64(0x9E3779B97F4A7C15)
                        held += c
                    at = at + _moves(w, j >> 9)[j & 511][c]
                step = first + SPAN
                keys.append(mix64(held))
                window.append(order[:n])
    return np.concatenate(keys), np.concatenate(window)


class Index:
    """The items of one block: texts; for each size of pieces a bit table and the pieces' sorted hashes with their
    items and the characters that stand before the piece; the sorted samples of the items' walks."""

    def __init__(self, ids: list, texts: list[str | None], share: float):
        self.items: list[tuple] = []
        self.whole: dict[str, list[int]] = {}  # items too short for a passage
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for i, text in zip(ids, _normal(pa.array(texts, pa.string())), strict=True):
            if text and text.count(" ") + 1 < LEAST_WORDS:
                self.whole.setdefault(text, []).append(len(self.items))
                self.items.append((i, text, 0))
            elif text:
                most = min(int(len(text) * share), len(text) - 1)
                size, starts = pieces(len(text), most)
                hashes = _runs(_codes(text), [size])[size]
                by_size.setdefault(size, []).extend((int(hashes[a]), len(self.items), a) for a in starts.tolist())
                self.items.append((i, text, most))
        self.sizes = np.array([(len(x[1]), x[2]) for x in self.items], np.int64).reshape(-1, 2)
        self.need = np.array([len(pieces(len(x[1]), x[2])[1]) - x[2] for x in self.items], np.int64)  # pieces that k edits leave
        self.tables = []
        for size, seeds in sorted(by_size.items()):
            keys, number, ahead = np.array(sorted(seeds), np.int64).T
            shift = 32 - min(26, max(16, len(seeds).bit_length() + 8))
            bits = np.zeros(1 << 32 - shift, bool)
            bits[keys >> shift] = True
            self.tables.append((size, shift, bits, keys, number, ahead))
        text = "".join(x[1] + "\n" for x in self.items)
        own = np.flatnonzero(self.sizes[:, 0] >= SHORT)
        begin = np.cumsum(self.sizes[:, 0] + 1) - self.sizes[:, 0] - 1
        keys, item = samples(_classes(_codes(text)), begin[own], spans_of(self.sizes[own, 0]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.sampled = keys[order], own[item[order]]

    def windows(self, text: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, document, item) of what pieces say: where the item would begin if nothing before the piece is edited."""
        runs = _runs(_codes(text), [x[0] for x in self.tables])
        found = []
        for size, shift, bits, keys, number, ahead in self.tables:
            at = np.flatnonzero(bits[runs[size] >> np.uint32(shift)])
            asked = runs.pop(size)[at].astype(np.int64)
            lo = np.searchsorted(keys, asked)
            n = np.searchsorted(keys, asked, side="right") - lo
            seed = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            found.append((np.repeat(at, n), number[seed], ahead[seed]))
        at, item, ahead = (np.concatenate(x) for x in zip(*found, strict=True))
        doc, place = np.searchsorted(first, at, side="right") - 1, at - ahead
        # pieces of one stretch say beginnings at most 2 * k apart: steps of k + 1, two of them to each side, hold them all
        step, far = place // (self.sizes[item, 1] + 1), int(self.sizes[:, 0].max(initial=0)) + 2
        key = (doc * len(self.items) + item) * (len(text) + 2 * far + 3) + step + far
        known, n = np.unique(key, return_counts=True)
        total = np.concatenate([[0], np.cumsum(n)])
        keep = total[np.searchsorted(known, key + 2, side="right")] - total[np.searchsorted(known, key - 2)] >= self.need[item]
        return np.maximum(place, first[doc])[keep], doc[keep], item[keep]

    def candidates(self, text: str, place: np.ndarray, doc: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, document, item) of windows whose samples equal an item's, and of those of short items."""
        short = self.sizes[item, 0] < SHORT
        yield place[short], doc[short], item[short]
        order = np.lexsort((-self.sizes[item, 0], place))[~short[np.lexsort((-self.sizes[item, 0], place))]]
        order = order[np.concatenate([[True], np.diff(place[order]) > 0])] if len(order) else order  # a place's longest window
        classes, spans = _classes(_codes(text + "\n")), spans_of(self.sizes[item, 0])
        for s in range(0, len(order), 1 << 17):
            part = order[s : s + (1 << 17)]
            keys, window = samples(classes, place[part], spans[part])
            lo = np.searchsorted(self.keys, keys)
            hit = np.flatnonzero(np.append(self.keys, 0)[lo] == keys)
            lo = lo[hit]
            n = np.searchsorted(self.keys, keys[hit], side="right") - lo
            seen = part[np.repeat(window[hit], n)]
            yield place[seen], doc[seen], self.sampled[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item number, edit distance, first word of the stretch)."""
        docs = _normal(texts)
        out = [(r, x, 0, 0) for r, t in enumerate(docs) for x in self.whole.get(t, ())] if self.whole else []
        if not self.tables or not len(texts):
            return out
        text = "\n".join(docs)  # no item holds a line break
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)])
        found = [np.zeros((0, 3), np.int64)]
        for place, doc, item in self.candidates(text, *self.windows(text, first)):
            found.append(np.unique(np.stack([doc, item, place // (self.sizes[item, 1] + 1)], 1), axis=0))
        found = np.unique(np.concatenate(found), axis=0)
        doc, item, begin = found[:, 0], found[:, 1], found[:, 2] * (self.sizes[found[:, 1], 1] + 1)
        m, most = self.sizes[item].T
        lo, hi = np.maximum(first[doc], begin - most), np.minimum(first[doc + 1] - 1, begin + most + m + most)
        return sorted(out + self._verify(text, first, doc, item, lo, hi))

    def _near(self, text: str, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which stretches of characters [lo, hi) may hold their item: k edits spoil at most k * GRAM of an item's
        runs of GRAM characters, so the rest must stand in some stretch as long as the item and k more, and each
        of them as often as the item has it."""
        grams = _grams(text)
        first, n = lo, np.maximum(hi - lo - GRAM + 1, 0)
        keep = np.ones(len(item), bool)
        table = np.zeros(1 << 16, bool)
        order = np.argsort(item, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            _, wanted, most = self.items[item[group[0]]]
            least = len(wanted) - GRAM + 1 - most * GRAM
            if least <= 0:
                continue
            own, span = _grams(wanted), len(wanted) + most - GRAM + 1
            table[own] = True
            often = np.bincount(own, minlength=1 << 16)
            parts = np.split(group, np.flatnonzero(np.diff(np.cumsum(n[group]) >> 22)) + 1)  # about 4 million places each
            for part in parts:
                k = n[part]
                stop = np.cumsum(k)
                start = stop - k
                seen = grams[np.arange(stop[-1]) + np.repeat(first[part] - start, k)]
                hit = table[seen]
                hits = np.concatenate([[0], np.cumsum(hit)])
                found = hits[np.minimum(np.arange(stop[-1]) + span, np.repeat(stop, k))] - hits[:-1]
                some = k > 0
                keep[part] = False
                if some.any():
                    keep[part[some]] = np.maximum.reduceat(found, start[some]) >= least
                hit &= np.repeat(keep[part], k)
                pair, times = np.unique(np.repeat(np.arange(len(part)), k)[hit] << 16 | seen[hit], return_counts=True)
                keep[part] &= np.bincount(pair >> 16, np.minimum(times, often[pair & 0xFFFF]), len(part)) >= least
            table[own] = False
        return keep

    def _verify(self, text: str, first: np.ndarray, doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(doc):
            return []
        near = np.flatnonzero(self._near(text, lo, hi, item))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        known: dict[tuple[int, str], int | None] = {}  # copies ask the same again
        for d, x, a, b in zip(*(v[near].tolist() for v in (doc, item, lo, hi)), strict=True):
            if best.get((d, x), (1,))[0] == 0:
                continue
            _, wanted, most = self.items[x]
            asked = x, text[a:b]
            if asked not in known:
                known[asked] = edit_distance_within(wanted, asked[1], most)
            found = known[asked]
            if found is not None and found < best.get((d, x), (most + 1,))[0]:
                best[d, x] = (found, a, b)
        out, began = [], {}
        for (d, x), (dist, a, b) in sorted(best.items()):
            asked = x, text[a:b]
            if asked not in began:
                began[asked] = _begin(self.items[x][1], asked[1])
            out.append((d, x, dist, text.count(" ", int(first[d]), a + began[asked] + 1)))
        return out


def indexes(benchmark: DataFrame, share: float) -> Iterator[Index]:
    """One index for each block of items."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        got = items.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(n)) == i).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        yield Index([x["item_id"] for x in got], [x["text"] for x in got], share)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1) -> DataFrame:
    """doc_id, item_id, edit_distance, first_word (of the stretch found): a row for each document and item that leaks into it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    item = benchmark.schema["item_id"].dataType

    def with_index(held):
        def run(batches):
            index = held.value
            for whole in batches:
                for b in slices(whole, "text", SLICE_BYTES):
                    got = index.search(b.column("text"))
                    yield pa.record_batch([
                        b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())), pa.array([index.items[g[1]][0] for g in got]).cast(item_type),
                        pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32()),
                    ], names=["doc_id", "item_id", "edit_distance", "first_word"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item)
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item.simpleString()}, edit_distance int, first_word int"
    return union_all([rows.mapInArrow(with_index(spark.sparkContext.broadcast(i)), kinds) for i in indexes(benchmark, share)])


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.1) -> DataFrame:
    """The rows of docs into which no item leaks, all columns."""

    def without(held):
        def run(batches):
            for whole in batches:
                for b in slices(whole, "text", SLICE_BYTES):
                    keep = np.ones(len(b), bool)
                    keep[[g[0] for g in held.value.search(b.column(b.schema.get_field_index("text")))]] = False
                    yield b.filter(pa.array(keep))

        return run

    for i in indexes(benchmark, share):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(i)), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
