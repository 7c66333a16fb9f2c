"""The language model against Kneser-Ney written with dictionaries."""

import collections
import math

import numpy as np
import pytest

from colguard.llm import language_id

TEXTS = {
    "x": ["Abba baab, aab bbb abab; ABBA 12 a", "baab ab a abba bab", "cabba"],
    "y": ["bcb ccb\nbcc abc", "ccc bcb 3 cab", "", None],
    "z": ["äöü ab äb ö", "öb üäb äbü"],
}


def grams_of(text):
    """Four characters each: every letter and the blank behind every word, with three blanks before a word."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = []
    for w in words:
        s = "   " + w + " "
        out += [s[i - 3 : i + 1] for i in range(3, len(s))]
    return out


class Brute:
    """Interpolated Kneser-Ney of order 4, character by character."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        top = collections.Counter(g for t in texts for g in grams_of(t))
        self.counts = {4: top}
        for k in (3, 2, 1):  # how many different characters stand before
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.discount = {}
        for k, c in self.counts.items():
            n1, n2 = (sum(v == n for v in c.values()) for n in (1, 2))
            self.discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1

    def p(self, gram, k=4):
        if k == 0:
            return 1 / (self.alphabet + 1)
        g = gram[4 - k :]
        total = sum(n for h, n in self.counts[k].items() if h[:-1] == g[:-1])
        lower = self.p(gram, k - 1)
        if not total:
            return lower
        kinds = sum(h[:-1] == g[:-1] for h in self.counts[k])
        seen = self.counts[k].get(g, 0)
        return max(seen - self.discount[k], 0) / total + self.discount[k] * kinds / total * lower


@pytest.mark.parametrize("bound", [1 << 20, 16])
def test_probabilities_and_scores(spark, bound):
    rows = [(i, t, lang, "s") for lang, texts in TEXTS.items() for i, t in enumerate(texts)] + [(9, "no language", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __source string")
    model = language_id.fit(df, grams=bound)
    assert model.langs == list(TEXTS) and bool(model.parts) == (bound == 16)
    chars = sorted({g[-1] for texts in TEXTS.values() for t in texts for g in grams_of(t)})
    brute = {lang: Brute(texts, len(chars)) for lang, texts in TEXTS.items()}
    asked = [a + b + c + d for a in " ab" for b in " abä" for c in " abcö" for d in [*chars, "q"] if not (c == " " and b != " ")]
    packed = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in asked], np.uint64)
    got = np.exp(model.log_probs(packed))
    want = np.array([[brute[lang].p(g) for g in asked] for lang in TEXTS])
    assert np.allclose(got, want, rtol=1e-9)
    for text in ("abba", "bcb ccb", "äb ö", "ab abc"):
        import pyarrow as pa

        best, score, _ = model.score(pa.array([text]))
        ll = [sum(math.log(brute[lang].p(g)) for g in grams_of(text)) for lang in TEXTS]
        assert best[0] == int(np.argmax(ll)) and abs(score[0] - 1 / sum(math.exp(x - max(ll)) for x in ll)) < 1e-9
    assert sorted(r["doc_id"] for r in language_id.accepted(df.where("lang IS NOT NULL"), model).collect()) == sorted(r[0] for r in rows[:-1] if grams_of(r[1]))
