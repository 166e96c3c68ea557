"""Fill-in-the-middle texts: prefix, middle and suffix in another order, between marks.

Texts are cut between code points without being decoded. Over the bytes of an Arrow batch a packed bitvector marks where
code points begin; a directory holds the popcounts of blocks of it, summed up. The rank of a text's end less that of its
start is its number of code points, and the select of a rank is the byte of a cut: the block by a search in the directory,
the place in the block by the popcounts of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a word, words of a block.
BITS, WORDS = 64, 8
#: Place of the k-th set bit (k from 0) of each byte, 8 where it has none.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
NTH = np.where(_SET.sum(1)[:, None] > np.arange(8), np.argsort(-_SET.astype(np.int8), axis=1, kind="stable"), 8).astype(np.int64)


class Boundaries:
    """Rank and select over where the code points of UTF-8 bytes begin."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        words = np.zeros(-(-len(data) // (BITS * WORDS)) * WORDS, np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64).reshape(-1, WORDS)
        #: code points before each block, and in all
        self.blocks = np.concatenate([[0], np.cumsum(counts.sum(1))])
        #: code points of a block before each of its words
        self.within = np.cumsum(counts, axis=1) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before byte at."""
        word, bit = at // BITS, (at % BITS).astype(np.uint64)
        last = word == len(self.words)  # the end of the data, at the end of a block
        word = np.where(last, 0, word)
        inside = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64) if len(self.words) else 0
        block = word // WORDS
        return np.where(last, self.blocks[-1], self.blocks[block] + (self.within[block, word % WORDS] if len(self.words) else 0) + inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte where the k-th code point begins, k from 0 and below their number."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        left = k - self.blocks[block]
        word = (self.within[block] <= left[:, None]).sum(1) - 1
        left -= self.within[block, word]
        octets = self.words.view(np.uint8).reshape(-1, BITS // 8)[block * WORDS + word]
        sums = np.cumsum(np.bitwise_count(octets).astype(np.int64), axis=1)
        octet = (sums <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left -= np.where(octet > 0, sums[row, octet - 1], 0)
        return (block * WORDS + word) * BITS + octet * 8 + NTH[octets[row, octet], left]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Per row of docs: key, n (code points), form, prefix_chars, middle_chars, output.

    Four draws h1 to h4 come from the sha256 of `salt:key` (a null key counts as an empty text). The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. plain_percent of the rows, by h3,
    stay as they are, and so do empty texts and those that hold a mark; of the others spm_percent, by h4, are suffix,
    prefix, middle (spm), the rest prefix, suffix, middle (psm), each part behind its mark. Null texts count as empty. Rows
    of a repeated key have the same draws. Other columns are left out."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    names = ["_key", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = part.column(1).cast(pa.large_string()).cast(pa.large_binary())
                rows = len(texts)
                ends = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, 8 * texts.offset)
                low = int(ends[0])
                raw = texts.buffers()[2]
                data = np.frombuffer(raw, np.uint8, int(ends[-1]) - low, low) if raw is not None and ends[-1] > low else np.zeros(0, np.uint8)
                h1, h2, h3, h4 = (part.column(k).to_numpy() for k in range(2, 6))
                held, ends = Boundaries(data), ends - low
                before = held.rank(ends)
                n = np.diff(before)
                first, second = (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1)))
                # a cut after the last code point is the text's end
                cuts = [ends[1:].copy(), ends[1:].copy()]
                for cut, units in zip(cuts, (first, second), strict=True):
                    inner = units < n
                    cut[inner] = held.select((before[:-1] + units)[inner])
                form, out = [], []
                whole = data.tobytes()
                for a, b, c, d, u, v in zip(ends[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), ends[1:].tolist(), h3.tolist(), h4.tolist(), strict=True):
                    t = whole[a:d]
                    if a == d or u % 100 >= 100 - plain_percent or p in t or s in t or m in t:
                        form.append("plain")
                        out.append(t)
                    elif v % 100 < spm_percent:
                        form.append("spm")
                        out.append(s + whole[c:d] + p + whole[a:b] + m + whole[b:c])
                    else:
                        form.append("psm")
                        out.append(p + whole[a:b] + s + whole[c:d] + m + whole[b:c])
                cut = np.array([f != "plain" for f in form], bool)
                chars = [pa.array(x, pa.int64(), mask=~cut) for x in (first, second - first)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())], names=names)

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *draws)
    return rows.mapInArrow(run, f"_key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts lie between marks, which no part holds."""

    def part(mark: str, until: str) -> Column:
        after = F.substring_index(output, mark, -1)
        return F.substring_index(after, until, 1) if until else after

    text = F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), part(MIDDLE, ""), part(SUFFIX, MIDDLE)))
    return text.when(form == "spm", F.concat(part(PREFIX, MIDDLE), part(MIDDLE, ""), part(SUFFIX, PREFIX))).otherwise(output)
