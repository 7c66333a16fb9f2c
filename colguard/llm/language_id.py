"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased and read as words of letters; a word is its letters and a closing blank behind three opening
blanks. For each language the counts of all 4-grams of all training documents are added up in Spark. From them
come the counts of ending, continuation counts for the lower orders (how many different characters stand before a
gram), discounts n1 / (n1 + 2 n2) for each order, and interpolated probabilities down to a uniform order 0. A
model is three sorted arrays for each order: gram hashes, their probabilities, and context weights. A document
gets the language with the lowest cross-entropy for each character.

Rejection: the rival gives each character its frequency over all languages, or one part of the alphabet if that is more.
The margin is the rival's cross-entropy less the best language's. Documents whose margin is under a threshold are
rejected; the threshold is the `quantile` of the margins of all training documents, counted in steps of 1 / STEPS, less
`slack`.

Bounds: no gram is dropped. Up to `grams` different 4-grams over all languages, the model is one broadcast, 40 bytes
a gram. With more, Spark counts the lower orders and what the discounts need over all grams, and the model is cut into
parts of about `grams` grams: orders 1 and 2 by the last character but one, orders 3 and 4 by the two characters before
the last, so all that a gram asks for stands in one part of each kind. The driver and each Python worker hold one part
at a time; the probabilities are the same.

Cases: a text that is null or has no letter gets `und`, score 0 and is rejected; without any training row every
document gets `und`; very long texts are scored whole; equal scores go to the first language in code-point order;
repeated rows count twice; other columns are not read (identify) or pass (accepted).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colguard.llm.common import Scratch, Words, mix64, release, slices

ORDER = 4
SLICE_BYTES, STEPS = 6 << 20, 1024
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word: packed grams (16 bits a character) of all words in a row, and each word's offsets;
    words are split again at what is no letter."""
    parts = [_NOT_LETTER.sub("   ", w).strip() for w in pc.utf8_lower(words).to_pylist()]
    odd = [i for i, p in enumerate(parts) if p and not p.isalpha() and not p.replace(" ", "").isalpha()]
    for i in odd:  # \w also holds numerals that are neither digits nor letters
        parts[i] = "   ".join("".join(c if c.isalpha() else " " for c in parts[i]).split())
    text = "   " + "".join(p + "    " if p else "" for p in parts)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    c = np.where(c > 0xFFFF, 0xE000 + c % 0x1900, c).astype(np.uint64)  # beyond 16 bits: folded
    blank = c == 32
    event = ~blank
    event[1:] |= blank[1:] & ~blank[:-1]
    event[:3] = False
    at = np.flatnonzero(event)
    grams = c[at] | c[at - 1] << np.uint64(16) | c[at - 2] << np.uint64(32) | c[at - 3] << np.uint64(48) if len(at) else np.zeros(0, np.uint64)
    size = np.fromiter((len(p) + 4 if p else 0 for p in parts), np.int64, len(parts))
    ends = 3 + np.cumsum(size)
    offsets = np.searchsorted(at, np.concatenate([[3], ends]))
    return grams, offsets[:-1], offsets[1:]


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows():
        for lang, (k, n) in held.items():
            yield pa.record_batch([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for whole in batches:
        for b in slices(whole, "text", SLICE_BYTES):
            langs = b.column("lang")
            for lang in pc.unique(langs).to_pylist():
                words = Words(b.column("text").filter(pc.equal(langs, lang)), lower=False)
                grams, lo, hi = _spell(words.uniq)
                times = np.bincount(words.ids, minlength=len(words.uniq)).astype(np.float64)
                k, n = _add_up(grams, np.repeat(times, hi - lo))
                old = held.get(lang)
                held[lang] = _add_up(np.concatenate([old[0], k]), np.concatenate([old[1], n])) if old else (k, n)
            if sum(len(k) for k, _ in held.values()) > 1_000_000:
                yield from rows()
                held.clear()
            release()
    yield from rows()


class Model:
    """Languages in order, each with orders 1 to ORDER of (hashes, probabilities) and (context hashes, weights)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.uniform = 1.0 / (len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in counts.values()]))) + 1 if counts else 1)
        self.levels = [self._fit(*counts[x]) for x in self.langs]
        self.parts: list[tuple[range, list[Broadcast]]] = []
        both = _add_up(np.concatenate([k & np.uint64(0xFFFF) for k, _ in counts.values()]), np.concatenate([n for _, n in counts.values()])) if counts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self._set_rival(*both)

    def _set_rival(self, chars: np.ndarray, n: np.ndarray) -> None:
        self.uniform = 1.0 / (len(chars) + 1)
        self.rival, self.rival_p, self.rival_rest = chars, np.maximum((n + 1) / (n.sum() + len(n) + 1), self.uniform), self.uniform

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": []}  # broadcasts are sent by the functions that use them

    @staticmethod
    def _low(keys: np.ndarray, order: int) -> np.ndarray:
        """The last `order` characters."""
        return keys if order == 4 else keys & np.uint64((1 << 16 * order) - 1)

    @staticmethod
    def _hash(keys: np.ndarray, order: int) -> np.ndarray:
        return mix64(keys ^ np.uint64(order) << np.uint64(61)) if order < 4 else mix64(keys)

    def _fit(self, keys: np.ndarray, n: np.ndarray) -> dict:
        tables = {ORDER: (keys, n)}
        for k in range(ORDER - 1, 0, -1):  # how many different characters precede
            up = tables[k + 1][0]
            tables[k] = _add_up(self._low(up, k), np.ones(len(up)))
        levels: dict = {}
        for k in range(1, ORDER + 1):
            g, c = tables[k]
            levels[k] = self._level(k, g, c, _discount((c == 1).sum(), (c == 2).sum()), self._interpolate(levels, g, range(1, k)))
        return levels

    def _level(self, k: int, g: np.ndarray, c: np.ndarray, d: float, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        u, inv = np.unique(g >> np.uint64(16), return_inverse=True)
        total = np.bincount(inv, weights=c)
        gamma = d * np.bincount(inv) / total
        p = (c - d) / total[inv] + gamma[inv] * lower
        h, hc = self._hash(g, k), self._hash(u, k + 4 & 7)
        o, oc = np.argsort(h), np.argsort(hc)
        return h[o], p[o], hc[oc], gamma[oc]

    def _interpolate(self, levels: dict, grams: np.ndarray, orders: range, p: np.ndarray | None = None) -> np.ndarray:
        """Probability of each gram's last character after the characters before it, by these orders over p (uniform)."""
        p = np.full(len(grams), self.uniform) if p is None else p
        for k in orders:
            h, ph, hc, gamma = levels[k]
            if len(h):
                g = self._low(grams, k)
                p = np.where(*_find(h, self._hash(g, k), ph), _weights(hc, self._hash(g >> np.uint64(16), k + 4 & 7), gamma) * p)
        return p

    def probs(self, grams: np.ndarray) -> np.ndarray:
        """[language, gram]; parts are loaded one after the other and let go."""
        if not self.parts:
            return np.stack([self._interpolate(x, grams, range(1, ORDER + 1)) for x in self.levels])
        p = np.full((len(self.langs), len(grams)), self.uniform)
        for orders, parts in self.parts:
            which = _part(grams, orders, len(parts))
            for s, held in enumerate(parts):
                on = np.flatnonzero(which == s)
                if len(on):
                    for i, levels in enumerate(held.value):
                        p[i, on] = self._interpolate(levels, grams[on], orders, p[i, on])
                    held.__dict__.pop("_value", None)
        return p

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """[language, gram]"""
        return np.log(self.probs(grams))

    def rival_log(self, grams: np.ndarray) -> np.ndarray:
        c = grams & np.uint64(0xFFFF)
        at = np.minimum(np.searchsorted(self.rival, c), len(self.rival) - 1)
        return np.log(np.where(self.rival[at] == c, self.rival_p[at], self.rival_rest))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: index of the language (-1: und), score, margin over the rival for each character."""
        words = Words(texts, lower=False)
        grams, lo, hi = _spell(words.uniq)
        rows = len(words.start) - 1
        if not self.langs or not len(grams):
            return np.full(rows, -1), np.zeros(rows), np.full(rows, -np.inf)
        u, inv = np.unique(grams, return_inverse=True)
        values = np.vstack([self.log_probs(u), self.rival_log(u), np.ones(len(u))])
        sums = []
        for v in values:
            run = np.concatenate([[0], np.cumsum(v[inv])])
            word = (run[hi] - run[lo])[words.ids]
            run = np.concatenate([[0], np.cumsum(word)])
            sums.append(run[words.start[1:]] - run[words.start[:-1]])
        ll, rival, n = np.stack(sums[:-2]), sums[-2], np.rint(sums[-1])
        seen = n > 0
        best = np.where(seen, ll.argmax(0), -1)
        top = ll.max(0)
        score = np.where(seen, 1 / np.exp(np.clip(ll - top, -700, 0)).sum(0), 0.0)
        return best, score, np.where(seen, (top - rival) / np.maximum(n, 1), -np.inf)


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1


#: Characters (bits of a gram) that say in which part a gram's low or high orders stand
_LOW, _HIGH = (range(1, 3), 0xFFFF), (range(3, ORDER + 1), 0xFFFFFFFF)


def _part(grams: np.ndarray, orders: range, n: int) -> np.ndarray:
    mask = dict((_LOW, _HIGH))[orders]
    return (((grams >> np.uint64(16) & np.uint64(mask)) * np.uint64(1_000_003) >> np.uint64(7)) % np.uint64(n)).astype(np.int64)


def _part_column(orders: range, n: int) -> Column:
    mask = dict((_LOW, _HIGH))[orders]
    return F.shiftright(F.shiftright("gram", 16).bitwiseAND(F.lit(mask)) * F.lit(1_000_003), 7) % F.lit(n)


def _find(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


def _weights(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where(*_find(keys, asked, values), 1.0)


def training_rows(docs: DataFrame) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def _by_lang(t: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    lang, gram, n = t.column("lang").combine_chunks(), t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
    out = {}
    for x in pc.unique(lang).to_pylist():
        on = np.asarray(pc.equal(lang, x))
        o = np.argsort(gram[on])
        out[x] = gram[on][o], n[on][o].astype(np.float64)
    return out


def _in_parts(counts: DataFrame, total: int, grams: int) -> Model:
    """A model of all the counts whose levels are in parts of about `grams` grams, each a broadcast of its own."""
    tables = {ORDER: counts}
    try:
        for k in range(ORDER - 1, 0, -1):  # how many different characters precede
            low = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
            tables[k] = tables[k + 1].groupBy("lang", low.alias("gram")).agg(F.count("*").alias("n")).persist()
        discount = {}
        for k, t in tables.items():
            for x in t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
                discount[k, x["lang"]] = _discount(x["n1"], x["n2"])
        chars = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("c")).agg(F.sum("n").alias("n")).orderBy("c").toArrow()  # 2^16 at most
        model = Model({})
        model.langs = sorted({x for _, x in discount})
        model._set_rival(chars.column("c").to_numpy().view(np.uint64), chars.column("n").to_numpy())
        rows = {k: total if k == ORDER else t.count() for k, t in tables.items()}
        none = np.zeros(0, np.uint64), np.zeros(0)
        for orders in (_LOW[0], _HIGH[0]):
            n = max(1, -(-sum(rows[k] for k in orders if k > 1) // grams))
            parts = []
            for s in range(n):
                levels: list[dict] = [{} for _ in model.langs]
                for k in orders:
                    got = _by_lang((tables[k] if k == 1 else tables[k].where(_part_column(orders, n) == s)).toArrow())
                    at = np.unique(np.concatenate([g for g, _ in got.values()] or [none[0]]))
                    lower = model.probs(at) if model.parts else None
                    for i, x in enumerate(model.langs):
                        g, c = got.get(x, none)
                        p = None if lower is None else lower[i, np.searchsorted(at, g)]
                        levels[i][k] = model._level(k, g, c, discount[k, x], model._interpolate(levels[i], g, range(orders.start, k), p))
                parts.append(counts.sparkSession.sparkContext.broadcast(levels))
            model.parts.append((orders, parts))
        return model
    finally:
        for k in range(1, ORDER):
            if k in tables:
                tables[k].unpersist()


def _held(spark: SparkSession, model: Model):
    """What gives the model in a Python worker."""
    held, parts = spark.sparkContext.broadcast(model), model.parts

    def get() -> Model:
        m = held.value
        m.parts = parts
        return m

    return get


def fit(docs: DataFrame, grams: int = 1 << 20) -> Model:
    """Learns from the rows of docs (text, lang) that have both."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    try:
        total = counts.count()
        return Model(_by_lang(counts.toArrow())) if total <= grams else _in_parts(counts, total, grams)
    finally:
        counts.unpersist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __lang, __score and __margin."""
    held = _held(docs.sparkSession, model)  # 40 bytes for each gram, in parts of fit's `grams`

    def run(batches):
        m = held()
        names = np.array([*m.langs, "und"], object)
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                best, score, margin = m.score(b.column(b.schema.get_field_index("text")))
                more = {"__lang": pa.array(names[best].tolist(), pa.string()), "__score": pa.array(score), "__margin": pa.array(np.maximum(margin, -1e9))}
                yield pa.record_batch([*b.columns, *more.values()], names=[*b.schema.names, *more])
                release()

    out = T.StructType([*docs.schema, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__margin", T.DoubleType())])
    return docs.mapInArrow(run, out)


def threshold(margins: DataFrame, quantile: float = 0.0005, slack: float = 0.5) -> float:
    """The quantile of the column __margin, in steps of 1 / STEPS, less slack; minus infinity without rows."""
    step = F.floor(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), F.col("__margin"))) * STEPS)
    counts = sorted(margins.where("__margin > -1e9").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())  # 128 * STEPS rows at most
    rank, seen = quantile * (sum(n for _, n in counts) - 1), 0
    for at, n in counts:
        seen += n
        if seen > rank:
            return at / STEPS - slack
    return -np.inf


def identify(rows: DataFrame, least: float) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of scored() rows; a margin under `least` is rejected."""
    return rows.select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__margin").alias("margin"), _rejected(least).alias("rejected"))


def _rejected(least: float) -> Column:
    return (F.col("__lang") == "und") | (F.col("__margin") < F.lit(float(least)))


def learnable(docs: DataFrame) -> Column:
    return docs["text"].isNotNull() & docs["lang"].isNotNull()


def accepted(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of docs that are not rejected, all columns. Without `least`, docs are what the model has learnt from, and
    their margins settle it."""
    rows = Scratch(docs.sparkSession, "accepted").put(scored(docs, model), "scored")
    least = threshold(rows.where(learnable(rows))) if least is None else least
    return rows.where(~_rejected(least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = training_rows(docs) & learnable(docs)
    model = fit(docs.where(train))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("learnt"))
    rows = Scratch(spark, "lang").put(scored(rows, model).drop("text"), "scored")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return identify(rows, threshold(rows.where("learnt"))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
