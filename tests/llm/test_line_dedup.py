"""Line dedup with many sites, where sketches decide, and with sets of lines above the broadcast bound."""

import collections
import re

import pytest

from colguard.llm import line_dedup
from colguard.llm.common import Scratch

KIND = "doc_id long, text string, source string, line long, site string, lines string, k1 int"


def brute(rows, sites, least):
    key = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    spread = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            spread[key(line)].add(s)
    gone = {k for k, s in spread.items() if len(s) >= sites and len(k) >= least}
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(stay), None if t is None else "\n".join(stay)))
    return sorted(out, key=str)


def found(spark, rows, sites, least):
    df = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], KIND)
    out = line_dedup.clean(df, Scratch(spark, "t"), sites=sites, least_chars=least)
    assert out.columns == ["doc_id", "n_lines", "n_removed", "text"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_many_sites(spark, monkeypatch, bound):
    """Lines on 150, 199, 200, 201 and 400 of 400 sites, threshold 200; every hot line stands in a third of the rows or more."""
    monkeypatch.setattr(line_dedup, "BROADCAST", bound)
    rows = []
    for s in range(400):
        lines = [name for name, n in (("On  four hundred", 400), ("on 201", 201), ("on 200", 200), ("on 199", 199), ("on 150", 150)) if s < n]
        rows += [(2 * s, "\n".join([*lines, f"own {s}", "On FOUR\thundred "]), f"site{s}"), (2 * s + 1 if s % 7 else None, f"x{s}\n" + "\n".join(reversed(lines)), f"site{s}")]
    rows += [(9000 + i, "on 199\non 150", f"site{i % 3}") for i in range(500)]  # more rows, no more sites
    assert found(spark, rows, 200, 4) == brute(rows, 200, 4)


def test_sketch_decides_far_lines(spark, monkeypatch):
    """Only lines near the threshold are counted exactly."""
    asked = []
    only = line_dedup._only
    monkeypatch.setattr(line_dedup, "_only", lambda rows, lines: asked.append(lines.count()) or only(rows, lines))
    rows = [(s, "\n".join(f"line {n}" for n in (10, 50, 99, 100, 300) if s < n), f"s{s}") for s in range(300)]
    assert found(spark, rows, 100, 4) == brute(rows, 100, 4)
    assert asked[0] == 2  # 99 and 100


def test_odd_rows(spark):
    """Null ids, texts and sites, repeated rows, short and blank lines, a long text, a text that loses all lines."""
    long = "\n".join(f"part {i % 500}" if i % 3 else "Shared  line\x0b here" for i in range(30_000))
    rows = [(None, "shared line here\nmine", "a"), (None, "shared line here\nmine", "a"), (None, None, "a"), (1, None, None), (2, "", "b"), (3, "\n", None), (3, "\n", None)]
    rows += [(4, "SHARED line here ", "c"), (5, long, "d"), (6, "ok\nok\n \t\nok", "e"), (7, "ok", "f"), (8, "ok", None), (9, " shared\r line here\nok", None), (9, " shared\r line here\nok", None)]
    for sites, least in ((3, 1), (3, 4), (1, 0), (99, 1)):
        assert found(spark, rows, sites, least) == brute(rows, sites, least)
    assert found(spark, [], 2, 1) == []
