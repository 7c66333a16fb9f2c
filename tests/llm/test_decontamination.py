"""Recall of the walks by share and place of edits, all pairs of a small table against edit distance, short items."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colguard.llm import decontaminate

SF = "/root/testdata/sf0.001"


def edited(rng, text, edits, place="spread"):
    """`edits` edits of characters, over the whole text or all within its first or middle stretch."""
    c = list(text)
    if place == "spread":
        at = rng.choice(len(c), edits, replace=False)
    else:
        first = 0 if place == "start" else len(c) // 2
        at = first + rng.choice(min(max(2 * edits, 4), len(c) - first), edits, replace=False)
    for p in sorted(at.tolist(), reverse=True):
        c[p : p + 1] = [["Z", c[p]], [], ["Q"]][int(rng.integers(3))]
    return "".join(c)


@pytest.mark.parametrize("words", [(8, 14), (15, 60), (60, 200), (300, 600)])
@pytest.mark.parametrize(("percent", "place"), [(1, "spread"), (3, "spread"), (5, "spread"), (7, "spread"), (10, "spread"), (5, "start"), (5, "middle"), (10, "start"), (10, "middle")])
def test_recall(words, percent, place):
    rng = np.random.default_rng([percent, words[0], len(place)])
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    n = 150 if words[1] <= 60 else 60 if words[1] <= 200 else 25
    items = [" ".join(rng.choice(vocab, rng.integers(*words))) for _ in range(n)]
    held = [edited(rng, t, len(t) * percent // 100, place) for t in items]
    texts = [" ".join([*rng.choice(vocab, 40), t, *rng.choice(vocab, 30)]) for t in held] + [" ".join(rng.choice(vocab, 200)) for _ in range(50)]
    index = decontaminate.Index(list(range(n)), items, 0.1)
    out = index.search(pa.array(texts))
    want = {i for i, t in enumerate(texts[:n]) if decontaminate.edit_distance_within(items[i], " ".join(t.lower().split()), len(items[i]) // 10) is not None}
    assert len(want) >= 0.95 * n
    assert sum((i, i) in {(d, x) for d, x, _, _ in out} for i in want) >= 0.9 * len(want)
    for d, x, dist, _ in out:
        assert decontaminate.edit_distance_within(items[x], " ".join(texts[d].lower().split()), len(items[x]) // 10) == dist


def test_all_pairs_of_a_small_table():
    """Every document against every third item by edit distance."""
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").combine_chunks()
    items = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()[::3]
    norm = [" ".join((t or "").lower().split()) for t in docs.to_pylist()]
    known = {}
    for t in set(norm):
        for x, item in enumerate(items):
            d = decontaminate.edit_distance_within(" ".join(item.lower().split()), t, int(len(item) * 0.1))
            if d is not None:
                known[t, x] = d
    want = {(r, x): known[t, x] for r, t in enumerate(norm) for x in range(len(items)) if (t, x) in known}
    got = {(r, x): d for r, x, d, _ in decontaminate.Index(list(range(len(items))), items, 0.1).search(docs)}
    assert want and got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_short_items_and_odd_texts():
    """Items under five words are equal to a whole text or nothing; five very short words are a passage."""
    items = ["Yes", "no  way out", "a b c d e", None, "", "yes", "x" * 9 + " y z w v"]
    index = decontaminate.Index(list(range(len(items))), items, 0.1)
    texts = ["yes", "yes or no way out", "No way\tout\n", "it is a b c d e f", None, "", "yes", "long " * 20_000 + "a b c d e", "p " + "x" * 9 + " y z w v"]
    found = [(d, index.items[x][0], dist, at) for d, x, dist, at in index.search(pa.array(texts))]
    assert found == [(0, 0, 0, 0), (0, 5, 0, 0), (2, 1, 0, 0), (3, 2, 0, 2), (6, 0, 0, 0), (6, 5, 0, 0), (7, 2, 0, 20_000), (8, 6, 0, 1)]
    assert decontaminate.Index([], [], 0.1).search(pa.array(texts)) == []
    assert index.search(pa.array([], pa.string())) == []


def test_walks_fall_in_step_again():
    """Samples of equal texts are equal; after one edit in the middle some samples behind it are, too."""
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnop "), 400))
    other = text[:200] + "Z" + text[200:]
    spans = decontaminate.spans_of(np.array([400]))
    same, changed = (decontaminate.samples(decontaminate._classes(decontaminate._codes(t + "\n")), np.array([0]), spans)[0] for t in (text, other))
    assert len(same) == decontaminate.WALKS * int(spans[0])
    equal = (same == changed).reshape(decontaminate.WALKS, -1)
    assert equal[:, :6].all() and equal[:, -1].any() and not equal.all()
