"""Mixture-controlled packing by deficit round-robin.

Documents are tokenized, each ended by one id, and wait in a queue for each source as units: a document, or a piece of at
most `unit` tokens of a longer one. Round after round each queue is credited its share of a window, by target
proportions, and gives whole units while its credit lasts; what is left, its deficit, is carried to the next round. So the
round of a unit is known from where it ends in its queue, and all of them can be put in order at once: by round, queue and
place. That order is cut into windows of `window` tokens, all of them full but the last; a document is cut only where it
is longer than `unit` or meets a window's end.

The order is a distributed sort of the units' places, a few numbers each; places in it are sums over partitions of sums
over rows, so that deficits and offsets carry from each partition to the next, and none waits for another.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, give_back, lean

#: How byte-level BPE cuts a text before merging; a fixed value of that kind of tokenizer.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both readers of a vocabulary must give this text the same ids.
PROBE = "It's  a pro-be:\n\n \tÜber 12,345 naïve rows'll 中文 été […] <|end|> don't\u00a0x"


class Encoder:
    """Texts -> token ids, as the tokenizers library gives them without special tokens of its own.

    The vocabulary of a byte-level BPE file is handed to tiktoken, which merges by the same ranks about five times as
    fast; the library the file is made for checks it on a probe, and does the work itself where they differ. It also
    takes each text that holds an added token (one id, wherever it stands) or that the fast reader can't cut: very long
    runs of blanks exceed its regular expressions' stack."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.load = lambda: Tokenizer.from_file(tokenizer_file)
        self.tokenizer = self.load()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else "<u4")
        self.fast = self._fast(vocabulary)
        if self.fast:
            self.tokenizer = None  # one vocabulary in memory is enough, until a text needs the other

    def _fast(self, vocabulary: dict[str, int]):
        import tiktoken

        # byte-level files write each byte as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
            made = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
            return made if made.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids else None
        except (KeyError, ValueError):
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of `kind`."""
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> bytes:
        if self.fast and not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind).tobytes()
            except ValueError:
                pass
        self.tokenizer = self.tokenizer or self.load()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def tokenize(docs: DataFrame, key: str, text: str, source: str, tokenizer_file: str, end_id: int, unit: int, rows: int = 256) -> DataFrame:
    """A row for each unit: _row (its number), _id, _source, _part, _end (tokens of the source up to its end, in its
    partition), _start (ids of the document before it), _n (its tokens), _doc (tokens of the document), _ids (bytes).

    The last unit of a document holds end_id."""
    names = ["_row", "_id", "_source", "_part", "_end", "_start", "_n", "_doc", "_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = Encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        give_back()  # what reading the vocabulary took
        given: dict[str | None, int] = {}
        end, size = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch, out = whole.slice(k, rows), []
                ids = encoder.encode([t or "" for t in batch.column(2).to_pylist()])
                for i, (s, data) in enumerate(zip(batch.column(1).to_pylist(), ids, strict=True)):
                    data += end
                    n = len(data) // size
                    for start in range(0, n, unit):
                        piece = min(unit, n - start)
                        given[s] = given.get(s, 0) + piece
                        out.append((part << 40 | made, i, s, given[s], start, piece, n, data[size * start : size * (start + piece)]))
                        made += 1
                number, of, s, ends, start, piece, n, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column(0).cast(pa.int64()).take(pa.array(of)), pa.array(s, pa.string()), pa.array([part] * len(of), pa.int32()), *[pa.array(x, pa.int64()) for x in (ends, start, piece, n)], pa.array(data, pa.binary())], names=names)

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text")).mapInArrow(lambda b: lean(run(b)), "_row long, _id long, _source string, _part int, _end long, _start long, _n long, _doc long, _ids binary")


def served(units: DataFrame, window: int, weights: Mapping[str | None, float] | None) -> DataFrame:
    """units (_row, _source, _part, _end, _n) -> _row, _round, _at: the unit's round and the tokens served before it.

    A queue's quantum is window * weight / all weights; a unit goes in the first round whose credits reach its end."""
    sums = durable(units.groupBy("_source", "_part").agg(F.sum("_n").alias("_sum")))
    order = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_base"))
    queues = sums.groupBy("_source").agg(F.sum("_sum").cast("double").alias("_weight"))
    if weights is not None:
        weigh = F.lit(1.0)
        for name, w in weights.items():
            weigh = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weigh)
        queues = queues.withColumn("_weight", weigh)
    total = queues.agg(F.sum("_weight")).first()[0] or 1.0
    known = base.join(queues.select(F.col("_source").alias("_q"), (F.col("_weight") * window / total).alias("_quantum")), F.col("_s").eqNullSafe(F.col("_q"))).select("_s", "_p", "_base", "_quantum")
    placed = units.join(broadcast_if_small(durable(known)), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    end = F.col("_base") + F.col("_end")
    rounds = placed.select("_row", "_n", "_source", F.ceil(end / F.col("_quantum")).cast("long").alias("_round"), end.alias("_last"))
    # a unit's end in its queue tells units of one round and queue apart, so that no sort key repeats
    ordered = rounds.repartitionByRange("_round", "_source", "_last").sortWithinPartitions("_round", "_source", "_last")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            if len(n):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), batch.column(2), pa.array(ends - n, pa.int64()), pa.array(ends, pa.int64())], names=["_row", "_of", "_round", "_local", "_until"])

    local = durable(ordered.select("_row", "_n", "_round").mapInArrow(add, "_row long, _of int, _round long, _local long, _until long"))
    # a row for each partition
    sizes = local.groupBy("_of").agg(F.max("_until").alias("_size"))
    ahead = F.coalesce(F.sum("_size").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = durable(sizes.select(F.col("_of").alias("_o"), ahead.alias("_ahead")))
    return local.join(broadcast_if_small(offsets), F.col("_of") == F.col("_o")).select("_row", "_round", (F.col("_ahead") + F.col("_local")).alias("_at"))


def cut(batches: Iterator[pa.RecordBatch], window: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Units with their place in all tokens -> their pieces, of so many units at once: Spark's batches are set by the session."""
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            batch = whole.slice(k, rows)
            of, starts, lengths, ids, numbers, offsets = [], [], [], [], [], []
            for i, (n, data, start, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_n", "_ids", "_start", "_at")), strict=True)):
                wide = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes()
                done = 0
                while done < n:
                    number, offset = divmod(at + done, window)
                    take = min(n - done, window - offset)
                    of.append(i)
                    starts.append(start + done)
                    lengths.append(take)
                    ids.append(wide[4 * done : 4 * (done + take)])
                    numbers.append(number)
                    offsets.append(offset)
                    done += take
            row = pa.array(of, pa.int64())
            long = [pa.array(x, pa.int64()) for x in (starts, lengths, numbers, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_source").take(row), long[0], long[1], pa.array(ids, pa.binary()), batch.column("_doc").take(row), long[2], long[3]], names=["_id", "_source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", source: str = "source", window: int = 2048, end_id: int = 1, unit: int | None = None, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """Per piece: key, source, start, length, ids (binary: unsigned little-endian 32-bit), doc_tokens, sequence_id, offset.

    weights are the sources' target proportions, 1 for those not named; by default a source weighs as many tokens as it
    has, so that all queues drain together. Queues that are empty leave their share to the others. unit is `window` by
    default. Null and empty texts are documents of end_id alone. Repeated keys are packed as often as they occur. Null
    sources have a queue of their own. Tokens are written once, two bytes each for small vocabularies."""
    if weights is not None and not all(w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    tokens = durable(tokenize(docs, key, text, source, tokenizer_file, end_id, unit or window))
    places = served(tokens.select("_row", "_source", "_part", "_end", "_n"), window, weights).select("_row", "_at")

    rows = tokens.join(places, "_row").select("_id", "_source", "_n", "_ids", "_start", "_doc", "_at")
    pieces = rows.mapInArrow(lambda b: lean(cut(b, window)), "_id long, _source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("_id", key).withColumnRenamed("_source", source)
