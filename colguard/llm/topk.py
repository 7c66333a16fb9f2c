"""Exact top-k search by inner product with KD-trees, one for each shard.

Components become integers, floor(1024 * x). A shard is SHARD vectors that follow each other in a task's input. Its
KD-tree splits nodes at the median of their widest dimension down to leaves, each node with the tight bounding box of
its vectors. No vector in a box scores more than sum(max(q * low, q * high)). A query visits a shard's nodes best bound
first from a heap and stops when the best bound is under the kth score. Nodes whose bound equals the kth score are
still visited, because a tie goes to the smaller id. The kth score is propagated twice: a first pass over FIRST vectors
gives each query a score that k vectors reach, from which every task starts; in a task, each shard starts from
the kth score of all shards before it. A task gives no candidate that its own kth score rules out.

Queries are taken in blocks of BLOCK. The vectors are dealt into files once; each block scans them, without a shuffle of
vectors. Bounds: a block of queries with their first kth scores is broadcast, BLOCK * (dimensions + 2) numbers; the
driver holds that and FIRST vectors; a task holds one shard, and k candidates for each query of the block.

Cases: vectors that are null, have a null id or hold null or non-finite components take no part; vectors of other lengths
are compared as if the shorter ended in zeros; repeated ids are separate candidates (a query's own id never is one) and a
repeated query id is one query, the vector that sorts first; where a sum of products could pass 2**53, Python integers
are used, so scores and kth scores are exact at any size; scores beyond 64 bits fail; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colguard.llm.common import Scratch, union_all

K, SHARD, LEAF, BLOCK, EVERY, FIRST, FILE = 10, 2048, 64, 4096, 100, 4096, 8192


class Tree:
    """A KD-tree over integer vectors (float64, or Python integers); nodes in arrays, leaves are ranges of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.kids = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            s, e, parent, side = stack.pop()
            rows = order[s:e]
            lo, hi = x[rows].min(0), x[rows].max(0)
            me = len(self.span)
            self.low.append(lo)
            self.high.append(hi)
            self.span.append((s, e))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = me
            wide = int(np.argmax(hi - lo))
            if e - s > LEAF and hi[wide] > lo[wide]:
                mid = (e - s) // 2
                order[s:e] = rows[np.argpartition(x[rows, wide], mid)]
                stack += [(s, s + mid, me, 0), (s + mid, e, me, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.x = ids[order], x[order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """[query, node]: no vector of the node scores more."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def best(self, q: np.ndarray, own: int, bound: np.ndarray, kth: float, k: int, found: list[tuple[int, int]]) -> float:
        """Puts (score, -id) of this tree's vectors into the heap `found` of the k best so far; gives the new kth score."""
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            a, b = self.kids[node]
            if a >= 0:
                heapq.heappush(heap, (-bound[a], a))
                heapq.heappush(heap, (-bound[b], b))
                continue
            s, e = self.span[node]
            score = self.x[s:e] @ q
            for i in np.flatnonzero(score >= kth).tolist():
                if self.ids[s + i] != own:
                    item = (int(score[i]), -int(self.ids[s + i]))
                    if len(found) < k:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
            if len(found) == k:
                kth = max(kth, found[0][0])
        return kth


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of integers as float64 (objects if sums of products could pass 2**53), shorter ones filled with zeros."""
    size = np.asarray(pc.list_value_length(values), np.int64)
    wide = int(size.max(initial=1))
    flat = np.asarray(values.flatten(), np.float64)
    x = np.zeros((len(values), wide))
    x[np.arange(wide)[None, :] < size[:, None]] = np.floor(flat * 1024)
    return x


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    wide = max(a.shape[1] for a in arrays)
    arrays = tuple(np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in arrays)
    most = [np.abs(a).max(initial=0) for a in arrays]
    if wide * most[0] * most[-1] < 2.0**53:
        return list(arrays)
    return [np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in arrays]


def _kth(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list:
    """For each query the kth score over these vectors, as an integer; minus infinity if there are fewer."""
    q, x = _exact(q, x)
    out = []
    for i in range(len(q)):
        score = (x @ q[i])[ids != qid[i]]
        out.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf)
    return out


def _search(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv, kth = held.value
        found: list[list[tuple[int, int]]] = [[] for _ in qid]
        kth = list(kth)
        for batch in batches:
            for at in range(0, len(batch) if len(qid) else 0, SHARD):
                b = batch.slice(at, SHARD)
                x, q = _exact(_matrix(b.column("embedding")), qv)
                tree = Tree(b.column("vec_id").to_numpy(), x)
                for s in range(0, len(q), 512):
                    bound = tree.bounds(q[s : s + 512])
                    for i, own in enumerate(bound, s):
                        if own[0] >= kth[i]:
                            kth[i] = tree.best(q[i], qid[i], own, kth[i], k, found[i])
        for s in range(0, len(qid), 512):
            rows = [(qid[i], -minus, score) for i in range(s, min(s + 512, len(qid))) for score, minus in found[i]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["query_id", "vec_id", "score"])

    return run


def candidates(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, vec_id, score: what the tasks could not rule out, at most k for each query and task."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = scratch.put(rows.repartition(max(1, -(-rows.count() // FILE)), F.xxhash64("vec_id", "embedding")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    first = rows.orderBy(F.xxhash64(F.col("vec_id"), F.lit(17)), "embedding").limit(FIRST).toArrow()
    first_id, first_x = first.column("vec_id").to_numpy(), _matrix(first.column("embedding").combine_chunks())
    found = []
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(blocks)) == i)
        got = some.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toArrow()  # BLOCK rows on average
        qid, q = got.column("vec_id").to_numpy(), _matrix(got.column("embedding").combine_chunks())
        held = spark.sparkContext.broadcast((qid, q, _kth(qid, q, first_id, first_x, k)))
        found.append(rows.mapInArrow(_search(held, k), "query_id long, vec_id long, score long"))
    return union_all(found)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose id is divisible by `every`."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return candidates(vectors, every, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
