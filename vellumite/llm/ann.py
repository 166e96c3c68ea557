"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt by hash to blocks of about `block_rows`. In a block every tree holds the block's vectors as a sorted
array of long hash strings: bit i says on which side of its i-th hyperplane a vector lies, hyperplanes being drawn at
random and cut at the median of a bounded sample. For a query each tree descends to the longest prefix it shares with an
entry, which is a pair of binary searches for each length; then all trees ascend together, one bit at a time, for more
candidates, until those met, an entry once for each tree, number `mentions` times the block's rows. Entries rank by the
bits they share with the query in all trees, as far as the ascent came; the first `share` of the block get exact distances,
and the blocks' best are merged. Blocks hold their vectors once, however many trees there are.

Every vector travels once, to its block; queries travel to every block. A task reads a block's vectors, then lets its
queries pass in batches, so that it holds one block and one batch, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit


@dataclass
class Forest:
    planes: np.ndarray  # trees x bits x dimensions
    cuts: np.ndarray  # trees x bits

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows: hash strings as integers, the first bit highest."""
        trees, bits, _ = self.planes.shape
        out = np.empty((trees, len(vectors)), np.uint64)
        weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        for t in range(trees):
            out[t] = ((vectors @ self.planes[t].T > self.cuts[t]).astype(np.uint64) * weights).sum(1)
        return out


def fit(rows: DataFrame, n: int, vector: str = "embedding", key: str = "vec_id", trees: int = 128, bits: int = 32, sample: int = 8192, seed: int = 9) -> Forest | None:
    """Learns the cuts from at most `sample` of the n rows, those of the least hashed keys. None without rows."""
    v = F.col(vector).cast("array<double>").alias("_v")
    picked = rows.where(unit(F.col(key), seed=seed) < min(1.0, 1.25 * sample / n)) if n else rows
    drawn = picked.select(F.xxhash64(key, F.lit(seed)).alias("_order"), F.col(key).alias("_id"), v).orderBy("_order", "_id", "_v").limit(sample).collect()
    if not drawn:
        return None
    lengths = [len(r["_v"]) for r in drawn]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    learned = np.array([r["_v"] for r in drawn if len(r["_v"]) == usual])
    planes = np.random.default_rng(seed).standard_normal((trees, bits, usual))
    return Forest(planes, np.stack([np.median(learned @ p.T, axis=0) for p in planes]))


def usable(vector: Column, dimensions: int | None = None) -> Column:
    """Not null, some component not zero, all components finite (and of the given length)."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & some & ((F.size(v) == dimensions) if dimensions else F.lit(True)), F.lit(False))


class Block:
    """One block's vectors as sorted arrays of hash strings, one for each tree."""

    def __init__(self, forest: Forest, ids: np.ndarray, vectors: np.ndarray):
        self.forest, self.ids, self.vectors = forest, ids, vectors
        strings = forest.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.arrays = np.take_along_axis(strings, self.order, 1)

    def shared_bits(self, first: np.ndarray, last: np.ndarray, mentions: float) -> np.ndarray:
        """For a query's ranges (lengths x trees) in the sorted arrays: the bits that each row shares with it, by the trees
        that met it in the ascent."""
        n, trees = len(self.ids), np.arange(first.shape[1])
        enough = np.flatnonzero((last - first).sum(1) >= mentions * n)
        stop = max(1, int(enough[-1])) if len(enough) else 1
        begin, sizes = first[stop], last[stop] - first[stop]
        at = np.cumsum(sizes) - sizes - begin  # what takes a place in a tree's array to one among all ranges
        # longer prefixes' ranges lie within shorter ones', so that a running sum of their ends is the depth at each place
        ends = [np.bincount((at + x[stop:]).ravel(), minlength=int(sizes.sum()) + 1) for x in (first, last)]
        depth = np.cumsum(ends[0] - ends[1])[:-1]
        # a place within the range of prefixes stop .. stop + depth - 1 shares stop + depth - 1 bits
        met = np.concatenate([self.order[t, begin[t] : begin[t] + sizes[t]] for t in trees])
        return np.bincount(met, weights=depth + stop - 1, minlength=n)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float, mentions: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, row id and distance of the k nearest candidates for each query."""
        ids, (trees, bits, _) = self.ids, self.forest.planes.shape
        asked = self.forest.strings(queries)
        # where each query's prefix of each length begins and ends in each tree's array
        first = np.empty((bits + 1, trees, len(queries)), np.int32)
        last = np.empty_like(first)
        for length in range(bits + 1):
            free = np.uint64((1 << (bits - length)) - 1)
            for t in range(trees):
                first[length, t] = np.searchsorted(self.arrays[t], asked[t] & ~free, "left")
                last[length, t] = np.searchsorted(self.arrays[t], asked[t] | free, "right")
        out = []
        for q in range(len(queries)):
            rank = self.shared_bits(first[:, :, q].astype(np.int64), last[:, :, q].astype(np.int64), mentions)
            others = np.flatnonzero(ids != query_ids[q])
            rank, want = rank[others], max(4 * k, int(np.ceil(share * len(ids))))
            while True:  # again with more, should a few ids hold all candidates
                # entries of equal rank are all in, so that the rows' order decides nothing
                at = others if want >= len(others) else others[rank >= np.partition(rank, len(others) - want)[len(others) - want]]
                if len(at) == len(others) or len(np.unique(ids[at])) >= k:
                    break
                want *= 2
            distance = np.sqrt(((self.vectors[at] - queries[q]) ** 2).sum(1))
            near = np.lexsort((ids[at], distance))
            near = near[np.sort(np.unique(ids[at][near], return_index=True)[1])][:k]
            out.append((np.full(len(near), query_ids[q]), ids[at][near], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id", share: float = 0.2, mentions: float = 12.0, block_rows: int = 8192, query_rows: int = 256, **options) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score (Euclidean distance), the k nearest found among rows of other ids.

    share of a block's vectors are candidates, and not fewer than 4 * k of them.
    Vectors that are null, zero, not finite or of another length than most of the sample, and rows of a null id, take no part.
    Repeated rows of one id count once, by their nearest vector. An empty side gives an empty result."""
    schema = "query_id long, vec_id long, score double"
    rows, queries = rows.where(F.col(key).isNotNull()), queries.where(F.col(key).isNotNull())
    good = rows.where(usable(F.col(vector)))
    n = good.count()
    forest = fit(good, n, vector, key, **options)
    spark = rows.sparkSession
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = forest.planes.shape[2]
    columns = [F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")]
    good, asked = good.where(usable(F.col(vector), dims)).select(*columns), queries.where(usable(F.col(vector), dims)).select(*columns)
    if good.groupBy("_id").count().where("count > 1").limit(1).count():
        good = good.dropDuplicates(["_id", "_v"])  # before the shuffle, so that copies of a row don't fill a block
    blocks = max(1, -(-n // block_rows))
    # vectors of one id are dealt apart, so that a hot id doesn't fill a block
    left = good.select(F.pmod(F.xxhash64("_id", "_v"), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("_query"), "_id", "_v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_query"), "_id", "_v")
    dealt = left.unionByName(right).repartition(blocks, "_block").sortWithinPartitions("_block", "_query")
    shared = spark.sparkContext.broadcast((forest.planes, forest.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, held, block = Forest(*shared.value), None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            vectors = batch.column(3).flatten().to_numpy().reshape(-1, dims)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                number, query = divmod(int(numbers[a]), 2)
                if number != now:
                    now, held, block = number, [], None
                if not query:
                    held.append((ids[a:b], vectors[a:b]))
                    continue
                if held:
                    block, held = Block(made, *(np.concatenate(x) for x in zip(*held, strict=True))), []
                if block is None:
                    continue
                for c in range(a, b, query_rows):
                    d = min(b, c + query_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.nearest(ids[c:d], vectors[c:d], k, share, mentions)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
