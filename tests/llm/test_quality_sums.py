"""Scores of the quality classifier: the same sums as by definition, with each n-gram hashed once."""

import numpy as np
import pytest
import xxhash

from vellumite.llm import quality_classifier
from vellumite.llm.quality_classifier import SubwordModel

TEXTS = ["", None, " \n", "a", "aaaaaa aaaaaa aaaaaa", "<> >< <<>>", "日本語 🎉🎉🎉🎉🎉 é́ ñ\x00b \U0010ffff", "x" * 5000 + " y", " ".join(f"w{k % 97}{k % 89}" for k in range(3000))]


def model(low=3, high=4, **bounds):
    rng = np.random.default_rng(1)
    return SubwordModel(rng.normal(0, 0.3, (1 << 12, 4)).astype(np.float32), rng.normal(0, 0.3, (4, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32), low, high, **bounds)


def by_definition(m, text):
    weight, base = m.folded()
    words, ids = (text or "").split(), []
    for before, w in zip([None, *words], words, strict=False):
        marked = f"<{w}>"
        grams = {marked[a : a + n] for n in range(m.low, m.high + 1) for a in range(len(marked) - n + 1)}
        ids += [0] * (before == w) + [1 + xxhash.xxh32_intdigest(g.encode("utf-8", "ignore")) % (len(weight) - 1) for g in (f" {w}", *grams)]
    return 1 / (1 + np.exp(-base - (weight[ids].mean() if ids else 0)))


@pytest.mark.parametrize(("low", "high"), [(3, 4), (1, 2), (2, 5), (4, 6)])
def test_sums_of_many_words_are_those_of_the_definition(low, high):
    for bounds in ({}, {"cache_words": 1, "cache_grams": 3, "group_words": 2}):
        m = model(low, high, **bounds)
        assert m.scorer()(TEXTS) == pytest.approx([by_definition(m, t) for t in TEXTS], abs=1e-9)


def test_each_ngram_is_hashed_once(monkeypatch):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcd"), 12)) for _ in range(2000)}
    grams = {f"<{w}>"[a : a + n] for w in words for n in (3, 4) for a in range(15 - n)}
    hashed, plain = [], xxhash.xxh32_intdigest
    monkeypatch.setattr(quality_classifier.xxhash, "xxh32_intdigest", lambda b: hashed.append(b) or plain(b))
    model().scorer()([" ".join(sorted(words))])
    assert len(hashed) == len(words) + len(grams)
    known = len(hashed)
    quality_classifier.counted(1 << 12, 3, 4)(" ".join(sorted(words)))
    assert len(hashed) == 2 * known
