"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams, taken in lower case inside each blank-separated word between spaces.
Each n-gram's weight is the product of its naive Bayes log-count ratio (how much likelier it is in toxic texts of the
learning sample) and a coefficient learned by logistic regression over the ratio-scaled features.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, learned, packed_arrays, sliced


def grams(word: str, buckets: int, low: int, high: int) -> list[int]:
    marked, h = f" {word} ", xxhash.xxh32_intdigest
    return [h(g.encode("utf-8", "ignore")) % buckets for g in {marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)}]


NOTHING = np.empty(0, np.int32)


class GramSets(dict):
    """Word -> array of its n-grams' buckets; forgets at `limit` words."""

    def __init__(self, buckets: int, low: int, high: int, keep: np.ndarray | None = None, limit: int = 200_000):
        super().__init__()
        self.args, self.keep, self.limit = (buckets, low, high), keep, limit

    def __missing__(self, word):
        ids = np.array(grams(word, *self.args), np.int32)
        if self.keep is not None:
            ids = ids[self.keep[ids]]
        self[word] = ids = ids if len(ids) else NOTHING
        return ids

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        parts = [x for x in map(self.__getitem__, set((text or "").lower().split())) if len(x)]
        return np.unique(np.concatenate(parts)) if parts else NOTHING


@dataclass
class RatioModel:
    """weight: by bucket, ratio times coefficient; zero where the n-gram says nothing."""

    weight: np.ndarray
    bias: float
    low: int
    high: int

    def scorer(self):
        sets = GramSets(len(self.weight), self.low, self.high, self.weight != 0)
        return lambda texts: 1 / (1 + np.exp(-np.clip([self.bias + self.weight[sets.of(t)].sum() for t in texts], -50, 50)))


def train(packed: list[bytes], labels: list[int], buckets: int = 1 << 19, low: int = 4, high: int = 5, least: int = 8, epochs: int = 12, rate: float = 0.05, shrink: float = 2e-3, smooth: float = 1.0, least_ratio: float = 0.7, seed: int = 3) -> RatioModel:
    """packed: each text's buckets as 32-bit integers; least: texts that an n-gram must occur in; least_ratio: absolute
    log-count ratio below which it is left out."""
    docs, y = [np.frombuffer(p, np.int32) for p in packed], np.array(labels, np.float64)
    if not len(docs) or y.min() == y.max():
        return RatioModel(np.zeros(buckets), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0, low, high)
    count = np.zeros((2, buckets))
    for ids, label in zip(docs, labels, strict=True):
        count[int(label), ids] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    # each class's share of texts with the n-gram
    ratio = np.log((count[1] + smooth) / (n[1] + 2 * smooth)) - np.log((count[0] + smooth) / (n[0] + 2 * smooth))
    keep = (count.sum(0) >= least) & (np.abs(ratio) >= least_ratio)
    ratio = np.where(keep, ratio, 0.0)
    docs = [ids[keep[ids]] for ids in docs]
    w, bias, rng = np.zeros(buckets), 0.0, np.random.default_rng(seed)
    weigh = len(y) / (2 * n)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, now = docs[k], rate * (1 - step / steps)
            step += 1
            r = ratio[ids]
            p = 1 / (1 + np.exp(-np.clip(bias + w[ids] @ r, -50, 50)))
            g = (p - y[k]) * weigh[int(y[k])]
            w[ids] -= now * (g * r + shrink * w[ids])
            bias -= now * g
    return RatioModel(w * ratio, float(bias), low, high)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", per_class: int = 2500, budget: int = 1 << 26, buckets: int = 1 << 19, low: int = 4, high: int = 5, **options) -> RatioModel:
    """Learns from a bounded sample: at most 1.25 per_class labelled texts of each class, chosen by hashed key, as far as
    their n-grams number at most `budget` (4 bytes each).

    Texts become n-grams on the executors and one of them trains; the driver receives the model."""

    def made(packed: list[bytes], y: list[int]) -> bytes:
        m = train(packed, y, buckets=buckets, low=low, high=high, **options)
        return packed_arrays(weight=m.weight, bias=np.array(m.bias))

    def grams_of():
        sets = GramSets(buckets, low, high, limit=200_000)

        def of(text: str | None) -> tuple[bytes, int]:
            ids = sets.of(text)
            return ids.tobytes(), len(ids)

        return of

    got = np.load(io.BytesIO(learned(labelled_sample(docs, labels, label, text, key, per_class), grams_of, made, budget)))
    return RatioModel(got["weight"], float(got["bias"]), low, high)


def score(docs: DataFrame, model: RatioModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a double column `into`: the probability of label 1. Null, empty and blank texts score by the bias alone.

    A column named `into` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.low, model.high))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = RatioModel(*shared.value).scorer()
        for batch, lists in sliced(batches):
            yield pa.array(np.concatenate([run(texts) for texts in lists]) if len(batch) else np.empty(0))

    return docs.withColumn(into, scored(F.col(text)))
