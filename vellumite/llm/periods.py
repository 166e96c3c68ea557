"""Runs: stretches of words that repeat with a period, several times over.

All lags are scanned: the array of a text's word numbers is compared with itself shifted by each lag p up to n /
min_exp, and stretches of agreement that are long enough are runs of period p. A run agrees on at least (min_exp - 1) * p
places in a row, so that a lag can be tested on every s-th place first, s a quarter of that, for a whole octave of lags at
once: of a run four such places in a row agree. Only lags of which four do are compared on all places. The same stretch is
found again at multiples of its period; the smallest lag is the period.

Texts that may have more than `lags` lags are scanned by ranges of so many, each a row of its own that Spark deals to
any task, with the word numbers; what the ranges find comes together by text. All others are scanned where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, sliced

FOUND = re.compile(WORD)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, places) of each longest stretch of at least so many places that agree with those lag further."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[:-lag] == ids[lag:]
    turns = np.flatnonzero(np.diff(same))
    starts, ends = turns[::2], turns[1::2]
    for k in np.flatnonzero(ends - starts >= least):
        yield int(starts[k]), int(ends[k] - starts[k])


def scan(ids: np.ndarray, low: int, high: int, min_exp: int = 4, least_words: int = 6) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest lag, of stretches of lag low <= p < high that are at least max(least_words, min_exp * p)
    words long and can't be extended."""
    n, found = len(ids), {}
    high = min(high, n // min_exp + 1)
    # places past the end agree with none
    wide = np.full(n + 2 * max(high, 1), -1, np.int32)
    wide[:n] = ids
    while low < high:
        until = min(high, 2 * low)
        # runs of these lags agree on so many places at least
        places = max(1, (min_exp - 1) * low, least_words - until + 1)
        step = max(1, places // 4)
        at = np.arange(0, n, step)
        some = 1 + max(0, (1 << 22) // max(1, len(at)))
        for begin in range(low, until, some):
            lags = np.arange(begin, min(until, begin + some))
            # row p: do the sampled places agree with those p further
            agree = np.lib.stride_tricks.sliding_window_view(wide, n)[lags[0] : lags[-1] + 1, ::step] == ids[::step]
            row = min(4, places)
            if agree.shape[1] >= row:
                # row agreeing samples one after another
                held = agree[:, : agree.shape[1] - row + 1].copy()
                for k in range(1, row):
                    held &= agree[:, k : agree.shape[1] - row + 1 + k]
                hit = held.any(axis=1)
            else:
                hit = np.ones(len(lags), bool)
            for lag in lags[hit].tolist():
                least = max(least_words, min_exp * lag)
                for start, length in stretches(ids, lag, least - lag):
                    found.setdefault((start, length + lag), lag)
        low = until
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those in a run after its first period, joined by a space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    inside = np.cumsum(drop)[:-1] > 0
    return " ".join(w for w, d in zip(words, inside.tolist(), strict=True) if not d)


def _runs(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _array(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] if runs is not None else None for runs in rows], pa.list_(RUN))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_exp: int = 4, least_words: int = 6, lags: int = 4096) -> DataFrame:
    """Per row of docs: key, n_words, runs (start, length, period, in words, by start and period), collapsed (the text's
    words but those in a run after its first period, joined by a space).

    A run is a stretch of words of smallest period p, at least max(least_words, min_exp * p) words long, that the words
    beside it don't extend; min_exp is 2 at least. Runs may overlap. Null and empty texts have no words. Rows of a repeated
    or null key are texts of their own. Other columns are left out. docs is read twice: texts long enough for more than
    `lags` lags apart from the rest."""
    if min_exp < 2 or least_words < 1 or lags < 1:
        raise ValueError("min_exp must be 2 at least, least_words and lags above 0")
    kind = dict(docs.dtypes)[key]
    names = ["_key", "n_words", "runs", "collapsed"]
    schema = f"_key {kind}, n_words long, runs {RUNS}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, parts in sliced([batch.column(1)]):
                for texts in parts:
                    sizes, runs, kept = [], [], []
                    for t in texts:
                        words = FOUND.findall(t or "")
                        sizes.append(len(words))
                        runs.append(_runs(scan(numbered(words), 1, len(words), min_exp, least_words)))
                        kept.append(collapsed(words, runs[-1]) if runs[-1] else " ".join(words))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(sizes, pa.int64()), _array(runs), pa.array(kept, pa.string())], names=names)
                    done += len(texts)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                words = FOUND.findall(batch.column(1)[i].as_py())
                columns = [pa.array([row], pa.int64()), batch.column(0).slice(i, 1), pa.array([len(words)], pa.int64()), pa.array([" ".join(words)], pa.string()), pa.array([numbered(words).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "_key", "n_words", "_words", "_ids"])
                row += 1

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low = batch.column("_low")[i].as_py()
                found = scan(np.frombuffer(batch.column("_ids")[i].as_py(), np.int32), low, low + lags, min_exp, least_words)
                numbers = [[s for s, _ in found], [n for _, n in found], list(found.values())]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("_row")[i].as_py()] * len(found), pa.int64()), *[pa.array(x, pa.int64()) for x in numbers]], names=["_row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = FOUND.findall(batch.column("_words")[i].as_py())
                runs = [(r["start"], r["length"], r["period"]) for r in batch.column("runs")[i].as_py() or []]
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(i, 1), batch.column("n_words").slice(i, 1), _array([runs]), pa.array([collapsed(words, runs)], pa.string())], names=names)

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # n words have n - 1 blanks between them
    may = F.length("_text") >= 2 * min_exp * (lags + 1) - 1
    short = rows.where(~F.coalesce(may, F.lit(False))).mapInArrow(whole, schema)
    long = durable(rows.where(may).mapInArrow(listed, f"_row long, _key {kind}, n_words long, _words string, _ids binary"))
    last = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_words") / min_exp))
    ranges = long.select("_row", "_ids", F.explode(F.sequence(F.lit(1).cast("long"), last, F.lit(lags).cast("long"))).alias("_low"))
    found = ranges.repartition(F.col("_row"), F.col("_low")).mapInArrow(ranged, "_row long, start long, length long, period long")
    settled = found.groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    by_text = settled.groupBy(F.col("_row").alias("_r")).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_by"))
    runs = F.transform("_by", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    scanned = long.drop("_ids").join(by_text.select("_r", runs.alias("runs")), F.col("_row") == F.col("_r"), "left")
    return short.unionByName(scanned.select("_key", "n_words", "runs", "_words").mapInArrow(finish, schema)).withColumnRenamed("_key", key)
