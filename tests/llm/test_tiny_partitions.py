"""One short row in each partition: batches of a few characters, empty batches, empty partitions."""

import pytest

from colguard.llm import decontaminate, language_id, line_dedup, mixing, near_dedup, quality, secrets, sharding, token_store, topk
from colguard.llm.common import Scratch

TEXTS = ["a", "a b", "a b c d", "", None, "\n", "é", "a b c d e", "1", " ", "a b c d e f", "password=abcdef"]
ROWS = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def frames(spark):
    """Each row in a partition of its own, and all of them in one."""
    kind = "doc_id long, text string, lang string, source string"
    rows = lambda n: spark.createDataFrame(spark.sparkContext.parallelize(ROWS, n), kind)
    return rows(2 * len(ROWS)), rows(1)


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, "é"), (3, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")

    def store(df):
        import public_tokenizers

        scratch = Scratch(spark, "t")
        path = scratch.path("store")
        token_store.write_store(df, path, public_tokenizers.path("word_bpe_49k.json"))
        return token_store.verified_documents(spark, path, scratch)

    return {
        "leaks": lambda df: decontaminate.leaks(df, bench), "clean": lambda df: decontaminate.clean(df, bench), "language": lambda df: language_id.identify(language_id.scored(df, language_id.fit(df)), -1.0).select("doc_id", "lang_pred"),
        "accepted": lambda df: language_id.accepted(df, language_id.fit(df)), "shards": lambda df: sharding.assign(df, 4).select("doc_id", "size", "text_crc32"), "quality": lambda df: quality.score(df, quality.fit(df, labels)),
        "groups": near_dedup.groups, "secrets": secrets.scan, "mix": mixing.mix, "lines": lambda df: line_dedup.clean(df, Scratch(spark, "t"), sites=2, least_chars=1), "store": store,
    }


@pytest.mark.parametrize("name", ["leaks", "clean", "language", "accepted", "shards", "quality", "groups", "secrets", "mix", "lines", "store"])
def test_partitions_do_not_matter(spark, frames, name):
    run = operators(spark)[name]
    apart, together = (sorted(map(str, [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run(df).collect()])) for df in frames)
    assert apart == together and apart


def test_vectors_in_tiny_partitions(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)]
    kind = "vec_id long, embedding array<double>"
    apart, together = (sorted(map(tuple, topk.top_k(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), kind), 5, 3).collect())) for n in (24, 1))
    assert apart == together and len(apart) == 9
