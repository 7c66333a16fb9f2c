"""Cut edges of shards against a plain deal, hot groups; the quality sample's bound in bytes, long and repeated rows."""

import collections

import numpy as np
from pyspark.sql import functions as F

from colguard.llm import quality, sharding


def split_groups(rows):
    spread = collections.defaultdict(set)
    for r in rows:
        if r["linked"]:
            spread[r["linked"]].add(r["shard"])
    return sum(len(v) > 1 for v in spread.values())


def test_few_cut_edges_at_40_shards(spark):
    """Groups of 2 to 20 copies among 4,000 documents: hardly one is split, where a deal by id splits nearly all."""
    rng = np.random.default_rng(1)
    texts = [f"copy {g}" for g in range(150) for _ in range(int(rng.integers(2, 21)))]
    texts += [f"alone {i}" for i in range(4000 - len(texts))]
    order = rng.permutation(len(texts))
    df = spark.createDataFrame([(int(i), texts[i], 1, "b") for i in order], "doc_id long, text string, shard int, linked string")
    out = sharding.assign(df).collect()
    n = collections.Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 40
    plain = [{"linked": r["linked"] if texts[r["doc_id"]].startswith("copy") else None, "shard": r["doc_id"] % 40} for r in out]
    assert split_groups(plain) > 140 and split_groups(out) <= 8


def test_groups_larger_than_a_shard(spark):
    """Half of all rows are one text, many are null: shards stay even, and the group fills whole shards."""
    rows = [(i, "same text" if i % 2 else None if i % 3 else f"t{i}") for i in range(2000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    n = collections.Counter(r["shard"] for r in out)
    assert set(n.values()) == {200} and sorted(r["doc_id"] for r in out) == list(range(2000))
    assert len({r["shard"] for r in out if r["linked"] and r["doc_id"] % 2}) <= 8
    assert all((r["text_crc32"] is None) == (rows[r["doc_id"]][1] is None) for r in out)


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Long documents end the sample early; repeated rows and documents score alike; a single label is its share."""
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(sum(len(t or "") for t in texts.to_pylist())) or train(texts, labels))
    good, bad = "This is a line of plain prose, and it goes on.\n", "xx || 1234 ## | 99 |\n"
    rows = [(i, (good if i % 2 else bad) * (200 if i % 10 == 0 else 5), "a", 0.5) for i in range(300)] + [(1, good * 5, "a", 0.5), (None, None, "b", 0.1), (500, "", "b", 0.1), (501, bad * 100_000, "b", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    field = quality.fit(docs, labels, sample_bytes=30_000)
    assert 0 < seen[-1] <= 30_000
    out = [tuple(r) for r in quality.score(docs, field).collect()]
    assert len(out) == len(rows) and all(0 <= s <= 1 for _, s in out)
    by = collections.defaultdict(set)
    for i, s in out:
        by[i].add(s)
    assert all(len(v) == 1 for v in by.values()) and min(by[3]) > 0.5 > max(by[501])
    assert quality.fit(docs, labels, sample_bytes=10) and {s for _, s in quality.score(docs.limit(5), quality.fit(docs, labels, sample_bytes=10)).collect()} == {0.5}
    ones = quality.fit(docs, labels.where(F.col("quality") == 1))
    assert {round(s, 6) for _, s in quality.score(docs.limit(5), ones).collect()} == {1.0}
