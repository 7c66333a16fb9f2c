"""Joins that deal hot keys into parts, alone and in the operators, with a bound so low that many keys are hot."""

import collections

import pytest
from pyspark.sql import functions as F
from test_llm_brute_force import brute_groups

from colguard.llm import common, near_dedup, token_store
from colguard.llm.common import Scratch, clean_up, hot_keys, salted_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 400 + [2] * 7 + [3] * 5 + [None] * 20 + list(range(10, 60)))], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (15, "e"), (None, "f"), (99, "g")], "k long, w string")
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")).where("k IS NOT NULL"), "k", "n", left.count())
    assert {r["__hot"]: r["__parts"] for r in hot.collect()} == {1: 80, 2: 2}
    got = salted_join(left, right, "k", hot, ["v"], how)
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))
    parts = {r[0] for r in salted_join(left, right, "k", hot, ["v"]).where("k = 1").select(F.spark_partition_id()).distinct().collect()}
    assert parts


def test_near_dedup_with_hot_keys(spark, monkeypatch):
    """Copies, near copies and versions of one text, most of them hot; rows without an id stay alone."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(0, 60)]
    rows += [(100 + i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(60)]
    rows += [(200 + i, " ".join([*base, *(f"tail{i}x{j}" for j in range(i % 40))])) for i in range(60)]
    rows += [(None, " ".join(base)), (None, "another text of five words"), (None, None), (400, None), (401, ""), (402, "short"), (403, "short")]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, key string, node int")
    out = near_dedup.groups(df).collect()
    want = brute_groups([r for r in rows if r[0] is not None])
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([*set(want.values()), None, None, None])


def test_token_store_with_hot_keys(spark, monkeypatch):
    """One passage in every text, one text many times: the store reads back as it was encoded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    passage = " ".join(f"passage word {i}" for i in range(400))
    rows = [(i, f"head {i} " + passage) for i in range(12)] + [(100 + i, "the same text") for i in range(15)] + [(200 + i, "") for i in range(9)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    store = scratch.path("store")
    token_store.write_store(df, store, path)
    tok = Tokenizer.from_file(path)
    want = collections.Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.read_documents(spark, store).collect()) == want
    told = token_store.verified_documents(spark, store, scratch).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in told) == collections.Counter((i, len(ids)) for i, ids in want.elements())
    clean_up(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{store}/chunks").count()
