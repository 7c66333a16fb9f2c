"""Exact top-k search beyond the shared cases: large scores, repeated and null ids, extra columns, propagated kth scores."""

import numpy as np
import pytest

from colguard.llm import topk


def brute(rows, every, k):
    """(query_id, rank, vec_id, score) with Python integers; a repeated query id is the vector that sorts first."""
    fine = [(i, [int(np.floor(1024 * x)) for x in e], e) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _, _ in fine if i % every == 0}):
        mine = min((e for i, _, e in fine if i == q))
        v = [int(np.floor(1024 * x)) for x in mine]
        best = sorted((-sum(a * b for a, b in zip(v, f, strict=False)), i) for i, f, _ in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(df, every=100, k=10):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, every, k).collect())


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 40])
def test_scores_past_float_precision(spark, n):
    """Scores over 2**53 that differ by one, and ties of them."""
    rows = [(100, [2.0**17, 1 / 1024])] + [(i, [2.0**16 + i // 2 / 1024, (i % 5 * 2 + 1) / 1024]) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 100, 10)
    assert found(df) == want and len(want) == min(n, 10)
    assert all(s > 2**53 for *_, s in want)


def test_repeated_ids_nulls_and_other_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in rng.integers(0, 60, 200)]
    rows += rows[:30] + [(None, [1.0, 1.0, 1.0]), (20, None), (40, []), (3, []), (5, [None, 1.0, 1.0]), (6, [float("-inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, score string, rank long, query_id long, kth double")
    assert found(df, 20, 7) == brute(rows, 20, 7)


def test_shards_blocks_and_kth(spark, monkeypatch):
    """Many shards, tasks and blocks; the kth scores leave fewer candidates than k for each query and shard."""
    for name, value in (("SHARD", 64), ("FILE", 500), ("BLOCK", 16), ("FIRST", 128), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 40, 10) == brute(rows, 40, 10)
    given, shards = topk.candidates(df, 40, 10).count(), -(-2000 // 64)
    assert 50 * 10 <= given < 50 * shards * 10 / 4


def test_each_shard_starts_from_the_kth_score_before_it():
    """In one task a later shard whose vectors all score less is left at its root."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(topk.SHARD, 4)) + 9, rng.normal(size=(topk.SHARD, 4))])
    batch = pa.record_batch([pa.array(np.arange(len(x))), pa.array(x.tolist())], names=["vec_id", "embedding"])

    class Held:
        value = (np.array([-1]), np.full((1, 4), 1024.0), [-np.inf])

    seen = []
    best = topk.Tree.best
    try:
        topk.Tree.best = lambda self, *a: seen.append(len(self.ids)) or best(self, *a)
        out = next(topk._search(Held, 10)(iter([batch])))
    finally:
        topk.Tree.best = best
    assert len(seen) == 1 and out.num_rows == 10
