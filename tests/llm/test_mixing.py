"""Mixing: inclusion shares against inclusion probabilities, edges found by splitting bins, repeated rows, many sources."""

import collections

import pytest
from pyspark.sql import functions as F

from colguard.llm import mixing
from colguard.llm.common import Scratch

KIND = "doc_id long, text string, source string, size long, target double, rank double, s string, bin int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3.0, "x", 4) for r in rows], KIND)


def factor_of(sizes, rest):
    """By trying: the factor for which the expected words are `rest`."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(1.0, mid * s) * s for s in sizes) < rest:
            low = mid
        else:
            high = mid
    return low


def test_shares_meet_probabilities(spark):
    """One source's documents of five sizes: over seeds, each size's share is about its probability."""
    sizes = [1] * 1500 + [5] * 1500 + [20] * 400 + [100] * 200 + [127] * 100 + [3000] * 2
    rows = [(i, " ".join(["w"] * n), "b") for i, n in enumerate(sizes)] + [(100_000 + i, " ".join(["w"] * 97), "a") for i in range(800)]
    df = frame(spark, rows).cache()
    seen = collections.Counter()
    seeds = 3
    for seed in range(seeds):
        out = mixing.mix(df, seed=seed).where("doc_id < 100000").collect()
        rest = out[0]["target"] - out[0]["target"] // out[0]["source_size"] * out[0]["source_size"]
        assert abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 64  # half of the longest that is not certain
        for r in out:
            seen[r["size"]] += r["taken"] // r["size"] - int(out[0]["target"] // out[0]["source_size"])
    factor = factor_of(sizes, rest)
    assert factor * 3000 > 1 > factor * 100
    for size, n in collections.Counter(sizes).items():
        p = min(1.0, factor * size)
        assert abs(seen[size] / seeds - n * p) <= (0 if p == 1 else 5 * (n * p * (1 - p) / seeds) ** 0.5 + 0.02 * n * p)


def words_of(rows):
    return {i: len((t or "").split()) for i, t, _ in rows}


@pytest.mark.parametrize("bins", [3])
def test_edges_by_splitting(spark, monkeypatch, bins):
    """The cut does not depend on how bins are split."""
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), f"s{i % 4}" if i % 9 else None) for i in range(600)]
    df = frame(spark, rows)
    want = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "LIMIT", 3)
    assert sorted(map(tuple, mixing.mix(df).collect())) == want


@pytest.mark.parametrize("bound", [500_000, 0])
def test_repeated_rows_are_numbered(spark, monkeypatch, bound):
    """A row that stands 900 times in a source of 1,000: the source still meets its target, and reruns agree."""
    monkeypatch.setattr(mixing, "BROADCAST", bound)
    rows = [(7, "one two three", "b")] * 900 + [(i, "w " * (i % 5 + 1), "b") for i in range(100)] + [(1000 + i, "v w x", "a") for i in range(1400)] + [(None, "n n", "a")] * 50
    df = frame(spark, rows).repartition(7)
    out = mixing.mix(df).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2.5 for s in target)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect())
    want = collections.Counter()
    for r in out:
        want[r["doc_id"]] += r["taken"] // r["size"]
    assert copies == +want
    assert mixing.mixed_documents(df).columns == df.columns


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_sources(spark, monkeypatch, few):
    """3,000 sources: weights and water level as in one pass over a sorted list."""
    monkeypatch.setattr(mixing, "SOURCES", few)
    n = 3000
    sizes = spark.range(n).select(F.concat(F.lit("h"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source"), (F.col("id") * 7919 % 101).alias("source_size")).union(spark.sql("SELECT NULL, 13L"))
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, Scratch(spark, "t")).collect()}
    rows = sorted(((r["source"], r["source_size"]) for r in sizes.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(s for _, s in rows)
    weight = {name: i % 3 + 1 for i, (name, _) in enumerate(rows)}
    low, high = 0.0, float(total)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, mid * weight[name]) for name, s in rows) < total else (low, mid)
    assert all(abs(got[name] - min(3 * s, low * weight[name])) < 1e-6 * (1 + got[name]) for name, s in rows)
