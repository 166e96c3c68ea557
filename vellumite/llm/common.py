"""What the operators of this subpackage share: row hashing, sampling of labelled rows, checkpoints, memory of workers."""

from __future__ import annotations

import ctypes
import io
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; a cluster gets an error, since
    its executors don't share one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumite-"))
    return named or context.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """For actions inside, Arrow batches of at most so many rows, so that long texts and arrays don't add up in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Freed memory goes back to the system. Python workers wait for later tasks, of other stages too, and their allocators
    would keep it, beside an executor whose heap has grown meanwhile."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(made: Iterator) -> Iterator:
    """What made, a task's batches, yields; then what it held is given back."""
    yield from made
    give_back()


def driver_gives_back(spark: SparkSession) -> None:
    """Between steps of many small queries: the driver's garbage goes, with the checkpoints, shuffles and broadcasts that
    nothing uses any more. Its heap would grow with what each query's plans leave, beside all that its many threads hold."""
    spark.sparkContext._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder all executors share, and read from there."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; else Spark shuffles, and splits what is skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def unit(*columns: Column | str, seed: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 1) for the values of the columns."""
    bits = F.xxhash64(*columns, F.lit(seed))
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def words(text: Column) -> Column:
    """All words of a text, as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shares_by_class(rows: DataFrame, label: str, key: str, per_class: int, seed: int) -> Column | None:
    """A condition that about per_class rows of each value of label meet, the same ones on each run; None without rows.

    It compares a hash of the key with per_class / count, so that it needs the counts only. The values of label are few."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    share = None
    for r in counts:
        cut = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, per_class / r["count"])))
        share = cut if share is None else F.coalesce(share, cut)
    return None if share is None else unit(F.col(key), seed=seed) < share


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, per_class: int, seed: int = 11) -> DataFrame | None:
    """_order, _id, _y, _text of about per_class keys of each class 0 and 1 (at most 1.25 per_class) that have a text.

    Keys are drawn from the labels alone; that list has a fixed bound, so it is broadcast. A key that repeats counts once,
    with its smallest text; a key with both labels counts as 0. None where there is nothing to draw from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    meets = shares_by_class(known, label, key, per_class, seed)
    if meets is None:
        return None
    drawn, seen = [], {}
    picked = known.where(meets).select(F.xxhash64(key, F.lit(seed)).alias("_order"), F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    for r in picked.orderBy("_order", "_id", "_y").limit(5 * per_class).collect():
        seen[r["_y"]] = seen.get(r["_y"], 0) + 1
        if seen[r["_y"]] <= 1.25 * per_class:
            drawn.append(tuple(r))
    if not drawn:
        return None
    listed = docs.sparkSession.createDataFrame(drawn, "_order long, _k long, _y int").groupBy("_order", "_k").agg(F.min("_y").alias("_y"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(listed), F.col("_id") == F.col("_k"))
    return rows.groupBy("_order", "_id", "_y").agg(F.min("_text").alias("_text"))


def learned(sample: DataFrame | None, features: Callable[[], Callable[[str], tuple[bytes, int]]], train: Callable[[list[bytes], list[int]], bytes], budget: int) -> bytes:
    """train's answer for the features of the sample's texts, in order of _order and _id.

    Texts become features where they lie; features go to one executor, which trains; the driver gets the trained model
    only. features() gives a function from a text to (packed features, their number); rows count until their features
    number `budget`, which bounds the trainer's memory whatever the texts' lengths."""
    if sample is None:
        return train([], [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            made = [of(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64())], names=["_order", "_id", "_y", "_packed", "_n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, labels, used = [], [], 0
        for batch in batches:
            for y, data, n in zip(*(batch.column(c).to_pylist() for c in ("_y", "_packed", "_n")), strict=True):
                used += n
                if used <= budget or not packed:
                    packed.append(data)
                    labels.append(y)
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([train(packed, labels)], pa.binary())], names=["_model"])

    rows = sample.select("_order", "_id", "_y", "_text").mapInArrow(lambda b: lean(pack(b)), "_order long, _id long, _y int, _packed binary, _n long")
    with small_batches(sample.sparkSession):
        found = rows.repartition(1).sortWithinPartitions("_order", "_id").mapInArrow(lambda b: lean(fit(b)), "_model binary").collect()
    return bytes(found[0]["_model"]) if found else train([], [])


def sliced(arrays: Iterator[pa.Array], rows: int = 256) -> Iterator[tuple[pa.Array, Iterator[list]]]:
    """Each array with its values as lists of at most so many, made one after another."""
    for array in arrays:
        yield array, (array.slice(k, rows).to_pylist() for k in range(0, len(array), rows))


def packed_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()
