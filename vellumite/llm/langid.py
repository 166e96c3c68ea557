"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its own learning texts. A text is encoded once with the
dictionary of each language; the language whose dictionary makes it smallest is chosen. When the runner-up is almost as
small, the answer is rejected: `lang` is then null, and `best` still says which was smallest.

What is encoded are a text's words, letters only and in lower case, so that capitals, digits and symbols don't hide the
language; the whole text is used, in blocks that are encoded by themselves, so that long texts don't become their own
dictionary. Equal sizes go to the language with more learning documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shares_by_class

LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "best string, lang string, score double, margin double, rejected boolean"


def normalized(text: str | None) -> bytes:
    """The words of a text, letters only and in lower case; empty if it has no letter."""
    found = LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in found for c in w):  # LETTERS also takes signs such as a raised two
        return b""
    return f" {' '.join(found)} ".encode("utf-8", "ignore") if found else b""


@dataclass
class LanguageModel:
    """Languages, most learning documents first, with their dictionaries."""

    dictionaries: dict[str, bytes]
    level: int = 9
    block: int = 4096
    margin: float = 0.01

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def classify(self, texts, compressors=None) -> pd.DataFrame:
        """score: 0.5 for a tie of the best two, towards 1 with the share of bytes that the best one saves."""
        compressors, names = compressors or self.compressors(), list(self.dictionaries)
        out = []
        for text in texts:
            data = normalized(text)
            if not data or not names:
                out.append(("und", None, 0.0, 0.0, True))
                continue
            blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
            best = min(range(len(names)), key=sizes.__getitem__)
            rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
            margin = (rest - sizes[best]) / rest
            rejected = margin < self.margin
            out.append((names[best], None if rejected else names[best], min(1.0, 0.5 + 2 * margin), margin, rejected))
        return pd.DataFrame(out, columns=["best", "lang", "score", "margin", "rejected"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 400, dictionary_bytes: int = 65536, **options) -> LanguageModel:
    """Learns from a sample of about docs_per_language texts of each language, drawn by hashed key; words are counted on
    the executors, and at most dictionary_bytes of each language reach the driver.

    Rows with null lang or text teach nothing; without any the model knows no language and answers `und`. The most
    frequent words of the sample stand last in the dictionary, where references to them are cheapest."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    meets = shares_by_class(known, lang, key, docs_per_language, 11)
    if meets is None:
        return LanguageModel({}, **options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter((name, w) for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in LETTERS.findall(t.lower()))
            words = [w.encode("utf-8", "ignore").decode() for _, w in counts]
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in counts], pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["_lang", "_word", "_n"])

    counted = known.where(meets).select(F.col(lang).cast("string"), F.col(text)).mapInArrow(count, "_lang string, _word string, _n long").groupBy("_lang", "_word").agg(F.sum("_n").alias("_n"))
    # as many words as fit: the driver gets at most dictionary_bytes of each language
    best = Window.partitionBy("_lang").orderBy(F.col("_n").desc(), "_word").rowsBetween(Window.unboundedPreceding, 0)
    fits = counted.withColumn("_size", F.sum(F.octet_length("_word") + 1).over(best)).where(F.col("_size") <= dictionary_bytes)
    chosen: dict[str, list[str]] = {}
    for r in fits.orderBy("_lang", "_size").collect():
        chosen.setdefault(r["_lang"], []).append(r["_word"])
    prior = {str(r[lang]): r["count"] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    names = sorted(chosen, key=lambda n: (-prior[n], n))
    return LanguageModel({name: f" {' '.join(reversed(chosen[name]))} ".encode() for name in names}, **options)


def classify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into` of RESULT; a column of that name is replaced.

    Null text, and text without a letter: best is `und`, lang null, score 0, rejected."""

    @F.pandas_udf(RESULT)
    def smallest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for batch in batches:
            yield model.classify(batch, compressors)

    return docs.withColumn(into, smallest(F.col(text)))
