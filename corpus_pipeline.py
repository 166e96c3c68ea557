"""A training corpus from documents, in stages: each takes what the one before it kept, as Parquet.

Filtering and rewriting stages return the columns of documents, whatever their names; packing returns the pieces of the
packed sequences. What each stage does with null texts, repeated keys and the like is said by the operator it calls: a null
or empty text scores by the classifier's bias, is near no other text, holds no personal data, has no words to mix and
is packed as its end alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm import minhash, mixing, packing, pii, quality_classifier
from vellumite.llm.common import shared_folder, table
from vellumite.llm.queries import pieces, pii_key, tokenizer_file

#: Documents that score below go.
LEAST_QUALITY = 0.3


def _spare(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below LEAST_QUALITY go."""
    model, score = quality_classifier.fit(docs, table(spark, sf_dir, "labels")), _spare(docs, "score")
    return quality_classifier.score(docs, model, into=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on shingles of five words, similarity 0.8 or more: one document of each group stays."""
    return minhash.deduplicate(docs, width=5)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates by the key that the session's configuration holds."""
    count = _spare(docs, "n_entities")
    return pii.pseudonymize(docs, pii_key(spark), into=count).drop(count)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(docs, tokenizer_file()))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII surrogates", replace_pii),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# The classifier's learned weights and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What stages wrote in between is deleted: the pieces rest on packing's own checkpoints."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
