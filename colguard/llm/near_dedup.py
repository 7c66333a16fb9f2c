"""Near-duplicate groups by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct shingles of five words (ASCII letters lower-cased, words
parted by ASCII white space). Of each hash, seven bits name one of 128 buckets; the bucket's least remainder is kept
as its count of leading zeros and the ten bits behind the first one (16 bits together). Empty buckets borrow from
full ones in an order that only depends on the bucket. 32 bands of four registers find candidates: two sets of
similarity 0.75 share no band with a probability under 0.00001. The share of equal registers, corrected for equal
registers by chance, estimates the similarity; pairs far below the threshold go no further. What is left is
confirmed on the full sets.

Skew: documents with equal sets are one node. In a bucket each node is compared with the bucket's smallest one
(linear). In buckets whose nodes are then still in more than one component, the nodes outside the bucket's most
frequent component and those inside it are dealt into blocks of BLOCK nodes; each block of outside nodes meets every
block in a task of bounded size (inside nodes are joined already); a task keeps a union-find and gives only edges that
join components, fewer than its nodes. So no link between components is lost and pairs are never written out.
Components come from alternating star steps in Spark.

Cases: null, empty or blank text: n_shingles 0, own component; fewer than five words: one shingle of all words;
rows with equal doc_id are one document (a row stays if its doc_id is its component's least); a null doc_id stays
alone; equal texts have similarity 1; very long texts use all their shingles; empty tables give empty results;
other columns are not read (groups) or pass (deduplicated).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colguard.llm.common import Scratch, Words, hash_words, hot_keys, mix64, odd_constants, release, salted_join, slices

SHINGLE, BUCKET_BITS, MANTISSA, BANDS, BLOCK, BLOCK_BYTES, SLICE_BYTES = 5, 7, 10, 32, 256, 16 << 20, 8 << 20
REGISTERS = 1 << BUCKET_BITS
ROWS = REGISTERS // BANDS
_REST = 64 - BUCKET_BITS


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each text's offsets."""
    words = Words(texts, lower=True)
    w = hash_words(words.uniq)[words.ids]
    mul = odd_constants(SHINGLE, 21)
    n = np.diff(words.start)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), np.uint64)
        for j in range(min(SHINGLE, len(w))):
            h[: len(w) - j] += w[j:] * mul[j]
        h = mix64(h)
        parts, out = [], [0]
        for s, k in zip(words.start[:-1].tolist(), n.tolist(), strict=True):
            if k >= SHINGLE:
                mine = np.sort(h[s : s + k - SHINGLE + 1])
                mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
            elif k:
                mine = mix64(np.array([(w[s : s + k] * mul[:k]).sum() + np.uint64(k)], np.uint64))
            else:
                mine = w[:0]
            parts.append(mine)
            out.append(out[-1] + len(mine))
    return np.concatenate(parts) if parts else w[:0], np.array(out)


def _probe_order() -> np.ndarray:
    """[bucket, step]: which bucket an empty one asks next; a permutation for each bucket from a hash."""
    keys = mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(99)).reshape(REGISTERS, REGISTERS)
    return np.argsort(keys, axis=1, kind="stable")


_PROBE = _probe_order()


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[document, bucket] 16-bit registers; rows of empty sets are 0."""
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    cell = doc * REGISTERS + (hashes >> np.uint64(_REST)).astype(np.int64)
    lead = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)  # sorted, so the first is the least
    v = hashes[lead] & np.uint64((1 << _REST) - 1)
    low = np.maximum(v, 1)
    size = np.frexp(low.astype(np.float64))[1]
    size = np.where(low >> (size - 1).astype(np.uint64) == 0, size - 1, size)  # rounded up to a power of two
    zeros = _REST - size
    shift = size - 1 - MANTISSA
    body = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    reg = np.zeros(docs * REGISTERS, np.int64)
    full = np.zeros(docs * REGISTERS, bool)
    reg[cell[lead]] = zeros << MANTISSA | body.astype(np.int64)
    full[cell[lead]] = True
    reg, full = reg.reshape(docs, REGISTERS), full.reshape(docs, REGISTERS)
    for r in np.flatnonzero(full.any(1) & ~full.all(1)):
        hole = np.flatnonzero(~full[r])
        order = _PROBE[hole]
        reg[r, hole] = reg[r, order[np.arange(len(hole)), full[r][order].argmax(1)]]
    return reg.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers, less what chance makes equal: two different least values agree in
    leading zeros and mantissa with a probability of about (1 / 3) / 2**MANTISSA, more for short sets that borrow."""
    same = (a == b).mean(-1)
    chance = 1 / (3 << MANTISSA) + np.minimum(1, 1 / np.maximum(na + nb, 1)) / (1 << MANTISSA)
    return np.maximum(0, (same - chance) / (1 - chance))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", SLICE_BYTES):
            h, off = shingle_sets(b.column("text"))
            reg = registers(h, off)
            keys, sigs = [], []
            for r, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                keys.append(hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest() if e > s else None)
                sigs.append(reg[r].tobytes() if e > s else None)
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(off)), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "key", "sig"])
            release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", SLICE_BYTES):
            h, off = shingle_sets(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array([h[s:e].tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "hashes"])
            release()


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = [_linked(x, y, percent) for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block_edges(percent: int, floor: float):
    """Of a pair of blocks: edges that join components not joined yet. Columns side, node, label, n, sig, hashes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        node, label, side = (table.column(c).to_pylist() for c in ("node", "label", "side"))
        n = table.column("n").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(node), REGISTERS)
        hashes = table.column("hashes").to_pylist()
        root = {x: x for x in label}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        alone = len(set(side)) == 1  # a block with itself
        cut = len(node) if alone else side.index(side[-1])
        out = []
        for i in range(len(node) if alone else cut):
            js = np.arange(i + 1 if alone else cut, len(node))
            mine = find(label[i])
            js = js[np.fromiter((find(label[j]) != mine for j in js), bool, len(js))]
            if not len(js):
                continue
            guess = estimate(sig[js], sig[i], n[js], n[i])
            for j in js[guess >= floor][np.argsort(-guess[guess >= floor], kind="stable")].tolist():
                if find(label[i]) != find(label[j]) and _linked(hashes[i], hashes[j], percent):
                    root[find(label[i])] = find(label[j])
                    out.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the least node it is connected with) of all nodes of edges (a, b): each step ties every
    neighbour to the least one, first those above a node, then those below, until nothing changes."""
    e = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    last, n = None, e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), f"{name}-least")
        ends = both.where("v > u")
        large = scratch.put(salted_join(ends, least.drop("c"), "u", hot_keys(least, "u", "c", 2 * n), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-large")
        scratch.drop(least)
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), f"{name}-least")
        small = scratch.put(salted_join(large, least.drop("c"), "u", hot_keys(least, "u", "c", 2 * n), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
        now = tuple(small.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())
        scratch.drop(e, large, least)
        e, n = small, now[0]
        if now == last or not now[0]:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5  # five standard deviations
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.put(rows.mapInArrow(_sign, "doc_id long, n long, key binary, sig binary"), "signed")
    alike = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key")
    nodes = scratch.put(alike.agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "nodes")

    bands = nodes.select("node", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("band", "part"))
    bands = scratch.put(bands.select("node", "n", F.xxhash64("band", "part").alias("bucket")), "bands")
    shared = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("c"), F.expr("bit_xor(xxhash64(node))").alias("who")).where("c > 1")
    # bands often hold the same nodes: one bucket of each set of nodes is enough
    shared = scratch.put(shared.groupBy("pivot", "c", "who").agg(F.min("bucket").alias("bucket")), "shared")
    hot = scratch.put(hot_keys(shared, "bucket", "c", bands.count()), "hot")
    members = scratch.put(salted_join(bands, shared.select("bucket", "pivot"), "bucket", hot, ["node"]), "members")
    scratch.drop(bands)
    asked = members.select("node").distinct()
    sets = scratch.put(rows.join(asked.hint("merge"), rows["doc_id"] == asked["node"], "left_semi").mapInArrow(_sets, "doc_id long, hashes binary"), "sets")
    sets = sets.select(F.col("doc_id").alias("node"), "hashes")
    mine = nodes.select("node", "n", "sig")

    first = scratch.put(members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot")), "first")
    pairs = first.join(sets.withColumnRenamed("hashes", "hb").hint("merge"), "node")
    asked_often = scratch.put(hot_keys(first.groupBy("pivot").agg(F.count("*").alias("c")), "pivot", "c", first.count()), "pivots")
    pairs = salted_join(pairs, sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("ha")), "pivot", asked_often, ["node"])
    edges = scratch.put(pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "ha", "hb").mapInArrow(_confirm(percent), "a long, b long"), "edges")
    found = scratch.put(components(edges, scratch, "first"), "labels")

    label = members.join(found.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    # in a bucket only the nodes outside its most frequent component meet the others, in blocks; those inside are joined
    sizes = label.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    count = lambda c, n: F.ceil(F.greatest(c / BLOCK, n * 8 / BLOCK_BYTES)).cast("int")
    open_ = open_.select("bucket", F.col("top.label").alias("major"), count(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("minors"), count(F.col("top.c"), F.col("top.n")).alias("majors"))
    inside = salted_join(label, scratch.put(open_, "open"), "bucket", hot, ["node"]).withColumn("minor", F.col("label") != F.col("major"))
    # blocks 0 to minors - 1 hold the nodes outside, those from `minors` on the nodes inside
    block = F.when(F.col("minor"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("majors")))
    inside = inside.withColumn("block", block.cast("int"))
    # a row for each meeting, with the number of the other block
    met = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1)))
    met = met.select("bucket", "node", "label", F.col("block").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = met.join(mine.hint("merge"), "node").join(sets.hint("merge"), "node")
    more = met.groupBy("bucket", "i", "j").applyInArrow(_block_edges(percent, floor), "a long, b long")
    more = scratch.put(more.distinct(), "more")
    final = scratch.put(components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), scratch, "last"), "components")
    by_key = nodes.join(final.hint("merge"), "node", "left").select("key", F.coalesce("label", "node").alias("component"))
    alone = signed.where("key IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))  # linked with nothing
    copies = scratch.put(hot_keys(nodes, "key", "copies", signed.count()), "copies")
    out = salted_join(signed.where("key IS NOT NULL AND doc_id IS NOT NULL"), by_key, "key", copies, ["doc_id"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay, all columns: of each group the one with the least doc_id."""
    scratch = Scratch(docs.sparkSession, "kept")
    gone = scratch.put(groups(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
