"""Quality classifier: supervised subword embeddings.

Every blank-separated word stands for its own hashed feature, for the character n-grams of the word between `<` and `>`,
and for a hashed pair with the word before it (pairs of equal words share one feature, since repetition is what such a
pair says). Each feature has a learned vector; a text is the mean of its features' vectors, and a softmax layer over that
mean gives the classes. Vectors and layer are trained together by plain stochastic gradient descent in numpy.

Since the layer is linear in the mean, a trained model folds to one number for each feature, and scoring adds these up.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lean, learned, packed_arrays, sliced

REPEAT = 0


class Memo(dict):
    """What `of` says of the keys met; all are forgotten when there are `limit`."""

    def __init__(self, of: Callable, limit: int):
        self.of, self.limit = of, limit

    def __missing__(self, key):
        made = self.of(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = made
        return made


def ngrams(word: str, low: int, high: int) -> dict[str, None]:
    """The distinct character n-grams of low to high characters of one word between `<` and `>`, in order."""
    marked = f"<{word}>"
    size = len(marked) + 1
    return dict.fromkeys([marked[i : i + n] for n in range(low, high + 1) for i in range(size - n)])


def bucket(feature: str, buckets: int) -> int:
    """The hashed feature of an n-gram, or of a word behind a blank."""
    return 1 + xxhash.xxh32_intdigest(feature.encode("utf-8", "ignore")) % (buckets - 1)


def pieces(words: list[str], chars: int) -> Iterator[list[str]]:
    """The words in lists of about so many characters; longer words by themselves."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // chars
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield words[a:b]


def summed(words: list[str], weight: np.ndarray, grams: Memo, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of the weights of its features and their number; grams has the weights of n-grams.

    The n-grams of all words are sorted, so that each is looked up once, and once for each word that has it."""
    text = "".join([f"<{w}>" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    own, left = np.repeat(np.arange(len(words)), sizes), np.repeat(sizes.cumsum(), sizes) - np.arange(len(text))
    total, number = weight[[bucket(f" {w}", len(weight)) for w in words]], np.ones(len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at, key = np.arange(len(text)), codes
    for n in range(1, high + 1):
        if n > 1:
            longer = left[at] >= n
            at, key = at[longer], key[longer] << 21 | codes[at[longer] + n - 1]
        if n < min(low, 3):  # three code points have 63 bits
            continue
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank, word = np.cumsum(new) - 1, own[at[order]]
        if n >= low:
            found = np.fromiter((grams[text[i : i + n]] for i in at[order[new]].tolist()), np.float64)
            once = new | (np.diff(word, prepend=-1) != 0)
            total += np.bincount(word[once], found[rank[once]], len(words))
            number += np.bincount(word[once], minlength=len(words))
        key = np.empty_like(rank)
        key[order] = rank
    return total, number


@dataclass
class SubwordModel:
    """vectors: buckets x dim; output: dim x classes; bias: classes. Class 1 is the label 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    low: int = 3
    high: int = 4
    cache_words: int = 200_000
    cache_grams: int = 200_000
    group_words: int = 50_000

    def folded(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log-odds of class 1, and what is there without any."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])

    def scorer(self):
        """A function from texts to scores. It keeps the sums of words and the weights of n-grams seen, and forgets them at
        cache_words and cache_grams; new words of some texts are summed together."""
        weight, base = self.folded()
        grams = Memo(lambda g: float(weight[bucket(g, len(weight))]), self.cache_grams)
        sums: dict[str, complex] = {}  # the real part sums the weights of the word's features, the imaginary part counts them

        def settle(waiting: list[tuple[int, list[str]]], out: np.ndarray) -> None:
            if len(sums) > self.cache_words:
                sums.clear()
            for some in pieces([*set().union(*(found for _, found in waiting)).difference(sums)], 1 << 18):
                total, number = summed(some, weight, grams, self.low, self.high)
                sums.update(zip(some, (total + 1j * number).tolist(), strict=True))
            for k, found in waiting:
                repeats = sum(map(str.__eq__, found, found[1:]))
                total = sum(map(sums.__getitem__, found))
                out[k] = base + (total.real + repeats * weight[REPEAT]) / (total.imag + repeats)

        def score(texts) -> np.ndarray:
            out, waiting, n = np.full(len(texts), base), [], 0
            for k, text in enumerate(texts):
                if found := text.split() if text else []:
                    waiting.append((k, found))
                    n += len(found)
                if n >= self.group_words:
                    settle(waiting, out)
                    waiting, n = [], 0
            settle(waiting, out)
            return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

        return score


def counted(buckets: int, low: int, high: int, limit: int = 200_000) -> Callable[[str | None], tuple[bytes, int]]:
    """A function from a text to its distinct features, ascending, and their shares (32 bits each), and their number.

    It keeps the features of words and n-grams seen, and forgets them at `limit` each."""
    grams = Memo(lambda g: bucket(g, buckets), limit)
    known = Memo(lambda w: np.array([bucket(f" {w}", buckets), *map(grams.__getitem__, ngrams(w, low, high))], np.int32), limit)

    def of(text: str | None) -> tuple[bytes, int]:
        found = (text or "").split()
        parts = [np.zeros(sum(map(str.__eq__, found, found[1:])), np.int32) + REPEAT, *map(known.__getitem__, found)]
        unique, counts = np.unique(np.concatenate(parts), return_counts=True)
        return unique.astype(np.int32).tobytes() + (counts / max(1, counts.sum())).astype(np.float32).tobytes(), len(unique)

    return of


def train(packed: list[bytes], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 6, rate: float = 4.0, low: int = 3, high: int = 4, seed: int = 5) -> SubwordModel:
    """Stochastic gradient descent, one text (features made by `counted`) at a time, rate falling to nothing; both
    classes weigh alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    docs = [(np.frombuffer(p, np.int32, len(p) // 8), np.frombuffer(p, np.float32, offset=len(p) // 2)) for p in packed]
    y = np.array(labels)
    share = np.array([max(1, (y == c).sum()) for c in (0, 1)])
    weigh = len(y) / (2 * share)
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, part = docs[k]
            now = rate * (1 - step / steps) * min(3.0, weigh[y[k]])
            step += 1
            if not len(ids):
                continue
            mean = part @ vectors[ids]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            wrong = -p / p.sum()
            wrong[y[k]] += 1
            back = output @ wrong
            output += now * 0.1 * np.outer(mean, wrong)
            bias += now * 0.01 * wrong
            vectors[ids] += now * part[:, None] * back[None] * 8
    return SubwordModel(vectors, output, bias, low, high)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", per_class: int = 2000, budget: int = 1 << 25, buckets: int = 1 << 17, low: int = 3, high: int = 4, **options) -> SubwordModel:
    """Learns from a bounded sample: at most 1.25 per_class labelled texts of each class, chosen by hashed key, as far as
    their features number at most `budget` (8 bytes each).

    Labels other than 0 and 1 and null texts teach nothing. Without rows the model answers by its starting vectors. Texts
    become features on the executors and one of them trains; the driver receives the model."""

    def made(packed: list[bytes], y: list[int]) -> bytes:
        m = train(packed, y, buckets=buckets, low=low, high=high, **options)
        return packed_arrays(vectors=m.vectors, output=m.output, bias=m.bias)

    got = np.load(io.BytesIO(learned(labelled_sample(docs, labels, label, text, key, per_class), lambda: counted(buckets, low, high), made, budget)))
    return SubwordModel(got["vectors"], got["output"], got["bias"], low, high)


def score(docs: DataFrame, model: SubwordModel, text: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with a double column `into`: the probability of label 1. Null, empty and blank texts score by the bias alone.

    A column named `into` is replaced; the model reads no column but text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.output, model.bias, model.low, model.high))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = SubwordModel(*shared.value).scorer()
        for batch, lists in sliced(batches):
            yield pa.array(np.concatenate([run(texts) for texts in lists]) if len(batch) else np.empty(0))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scores(batches))

    return docs.withColumn(into, scored(F.col(text)))
