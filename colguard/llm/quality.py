"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes, lengths, repetition, and the same
shares of the lines before and behind it. The field (unary weights and a 2 x 2 transition) is trained on labelled
documents, by gradient steps on the exact log-likelihood (forward and
backward over all lines). Lines start with their document's label; then lines of bad documents that an unchained
fit finds good become good, the worst line of each excepted. A document's good share is the mean of its lines' marginals, weighted by length; a
logistic curve fitted on the same documents makes it a probability.

Bound: at most `sample` labelled documents are used to fit, those with the smallest hashes of doc_id and text, and of
them as many as hold `sample_bytes` of text; of each its whole text. Scoring covers every document and every line.

Cases: a null, empty or blank text has one empty line and is scored like any other; repeated rows get equal
scores; without labelled rows, or with one label only, every document gets that label's share (0.5 if none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard.llm.common import Words, slices

_CLASSES = 8


def _class_table() -> np.ndarray:
    """Byte to class: 1 lower-case or not ASCII, 2 upper-case, 3 digit, 4 blank, 5 sentence mark, 6 bar, 7 other symbol."""
    t = np.full(256, 7, np.uint8)
    t[128:] = 1
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[[32, 9, 11, 12, 13]] = 4
    t[[ord(c) for c in ".,;:'\"()-?"]] = 5
    t[ord("|")] = 6
    return t


_TABLE = _class_table()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, their lengths in bytes, and the offsets of the documents."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    flat, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
    flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    n = len(flat)
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if n else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = _TABLE[data]
    size = np.diff(at).astype(np.float64)
    full = size > 0
    first = at[:-1][full]
    share = np.zeros((n, _CLASSES))
    turns = np.zeros(n)  # changes between letters and symbols
    if len(first):
        for c in range(1, _CLASSES):
            share[full, c] = np.add.reduceat((kind == c).astype(np.int32), first)
        letter = kind <= 2
        glued = np.zeros(len(kind), np.int32)
        glued[1:] = (kind[1:] == 7) & letter[:-1]
        turns[full] = np.add.reduceat(glued, first)
    blanks = share[:, 4] + 1
    share /= np.maximum(size, 1)[:, None]
    words = Words(flat, lower=True)
    n_words = np.diff(words.start)
    line = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(line), np.float64)
    same[1:] = (words.ids[1:] == words.ids[:-1]) & (line[1:] == line[:-1])
    same = np.bincount(line, weights=same, minlength=n) / np.maximum(n_words, 1)
    pair = np.unique(line * np.int64(len(words.uniq) + 1) + words.ids)
    fresh = np.bincount(pair // (len(words.uniq) + 1), minlength=n) / np.maximum(n_words, 1)
    stale = (1 - fresh) * np.minimum(1, 20 / np.maximum(n_words, 1))  # long lines repeat words by nature
    code = np.asarray(flat.dictionary_encode().indices) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, inv, times = np.unique(doc * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
    again = (times[inv] > 1) & full
    base = np.column_stack([
        share[:, 1], share[:, 2], share[:, 3], share[:, 5], 4 * share[:, 6], 4 * share[:, 7], turns / blanks, share[:, 4] * 2,
        np.log1p(size) / 8, np.minimum(np.log1p(np.maximum(size - blanks, 0) / blanks) / 3, 2), again, ~full, 2 * same, 2 * stale,
    ]).astype(np.float64)
    lead = np.zeros(n, bool)
    lead[offsets[:-1]] = True
    tail = np.zeros(n, bool)
    tail[offsets[1:] - 1] = True
    near = base[:, [1, 4, 5, 6, 8, 12]]
    before, behind = np.vstack([near[:1] * 0, near[:-1]]) * ~lead[:, None], np.vstack([near[1:], near[:1] * 0]) * ~tail[:, None]
    lines = np.log1p(np.diff(offsets))[doc] / 8
    return np.hstack([base, before, behind, lead[:, None], tail[:, None], lines[:, None], np.ones((n, 1))]), np.maximum(size, 1), offsets


def marginals(unary: np.ndarray, trans: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line given its document, and the expected transitions [2, 2] summed. unary: the log-odds
    of good. Documents of one length are done together, so long ones cost no padding."""
    n = len(unary)
    p, pairs = np.zeros(n), np.zeros((2, 2))
    size = np.diff(offsets)
    # documents by length; all documents that still have a line t move together
    order = np.argsort(-size, kind="stable")
    starts, left = offsets[:-1][order], size[order]
    e = np.exp(np.clip(np.column_stack([np.zeros(n), unary]), -30, 30))
    e /= e.sum(1, keepdims=True)
    m = np.exp(np.clip(trans, -8, 8))
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    most = int(left.max(initial=0))
    alive = np.searchsorted(-left, -np.arange(most), side="left")  # documents with more than t lines
    for t in range(most):
        i = starts[: alive[t]] + t
        a = e[i] if t == 0 else (alpha[i - 1] @ m) * e[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        i = starts[: alive[t + 1]] + t
        b = (beta[i + 1] * e[i + 1]) @ m.T
        beta[i] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    p = g[:, 1] / g.sum(1)
    inner = np.ones(n, bool)
    inner[offsets[1:] - 1] = False
    i = np.flatnonzero(inner)
    if len(i):
        x = alpha[i][:, :, None] * m[None] * (e[i + 1] * beta[i + 1])[:, None, :]
        pairs = (x / x.sum((1, 2), keepdims=True)).sum(0)
    return p, pairs


class Field:
    def __init__(self, w: np.ndarray, trans: np.ndarray, curve: tuple[float, float] = (1.0, 0.0), only: float | None = None):
        self.w, self.trans, self.curve, self.only = w, trans, curve, only

    def share(self, texts: pa.Array) -> np.ndarray:
        """Log-odds of each document's length-weighted mean marginal."""
        x, size, offsets = features(texts)
        p, _ = marginals(x @ self.w, self.trans, offsets)
        total = np.add.reduceat(p * size, offsets[:-1]) / np.add.reduceat(size, offsets[:-1])
        total = np.clip(total, 1e-6, 1 - 1e-6)
        return np.log(total / (1 - total))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.only is not None or not len(texts):
            return np.full(len(texts), 0.5 if self.only is None else self.only)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.share(texts) + b, -30, 30)))


def _climb(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offsets: np.ndarray, steps: int, decay: float, chained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions (none if not chained) by gradient steps on the log-likelihood of the lines' labels."""
    inner = np.ones(len(y), bool)
    inner[offsets[1:] - 1] = False
    seen, pairs, at = np.zeros((2, 2)), np.zeros((2, 2)), np.flatnonzero(inner)
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    k = x.shape[1]
    theta, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for t in range(1, steps + 1):
        w, trans = theta[:k], theta[k:].reshape(2, 2)
        if chained:
            p, pairs = marginals(x @ w, trans, offsets)
        else:
            p, pairs = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), seen
        grad = np.concatenate([((y - p) * weight) @ x / (len(offsets) - 1) - decay * w, ((seen - pairs) / max(1, len(at)) - decay * trans).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:k].copy(), theta[k:].reshape(2, 2).copy()


def train(texts: pa.Array, labels: np.ndarray, steps: int = 120, decay: float = 1e-3) -> Field:
    if not len(labels) or labels.min() == labels.max():
        return Field(np.zeros(1), np.zeros((2, 2)), only=float(labels.mean()) if len(labels) else 0.5)
    x, _, offsets = features(texts)
    y = np.repeat(labels, np.diff(offsets)).astype(np.float64)
    size = np.diff(offsets)
    weight = np.repeat(1 / size, size)  # each document counts alike in the unary part
    bad = np.repeat(labels == 0, size)
    doc = np.repeat(np.arange(len(labels)), size)
    w, trans = _climb(x, y, weight, offsets, steps, decay, chained=False)
    for _ in range(2):  # lines of a bad document that look good are good; its worst line stays bad
        p = x @ w
        worst = np.minimum.reduceat(p, offsets[:-1])
        y = np.where(bad, (p > 0) & (p > worst[doc]), y).astype(np.float64)
        w, trans = _climb(x, y, weight, offsets, steps, decay, chained=True)
    field = Field(w.copy(), trans.copy())
    s, a, b = field.share(texts), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve, a little pulled to (1, 0)
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r = q * (1 - q)
        h = np.array([[(r * s * s).sum() + 1, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, [((labels - q) * s).sum() - (a - 1), (labels - q).sum()])
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    field.curve = (max(a, 1e-3), b)
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_bytes: int = 64 << 20) -> Field:
    """docs (doc_id, text), labels (doc_id, quality); both already without held-out rows."""
    named = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    # the smallest hashes first, on ids alone, so that texts are read for `sample` rows only
    picked = named.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "quality").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # `sample` rows at most
    rows = rows.select("quality", "text", F.octet_length("text").alias("size"), F.xxhash64("doc_id", "text", "quality").alias("h"))
    least = rows.orderBy("h").limit(sample).select("h", "size").toArrow().sort_by("h")  # no texts yet
    fits = np.cumsum(np.asarray(pc.fill_null(least.column("size"), 0), np.int64)) <= sample_bytes
    if not fits.any():
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    last = int(least.column("h").to_numpy()[np.flatnonzero(~fits)[0] - 1 if not fits.all() else -1])
    got = rows.where(F.col("h") <= last).orderBy("h").limit(sample).select("text", "quality").toArrow()
    return train(got.column("text").combine_chunks(), got.column("quality").to_numpy())


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                yield pa.record_batch([b.column("doc_id"), pa.array(field.score(b.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = score(docs, fit(docs, labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
