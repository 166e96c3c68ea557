"""The queries of the operators over the standard tables, with production parameters."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, fim, langid, minhash, mixing, oracles, packing, periods, pii, quality_classifier, quality_rules, sharding, toxicity
from .common import crc_bucket, table, words


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file()))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("char_distance", "common_distance")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The setting that holds the key of surrogates. Without it surrogates can be reckoned by whoever knows an entity.
PII_KEY = "vellumite.pii.key"


def pii_key(spark: SparkSession) -> str:
    key = spark.conf.get(PII_KEY, None)
    if not key:
        warnings.warn(f"{PII_KEY} isn't set: surrogates are not secret", stacklevel=2)
    return key or "unset"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(64)], 6553


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(docs.where(~held_out), labels.where(~held_out))
    scored = quality_classifier.score(docs.select("doc_id", "text"), model, into="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model, into="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows keep the smallest language as lang_pred; `rejected` tells them apart."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held_out))
    found = langid.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.best").alias("lang_pred"), "language.score", "language.rejected")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document of ten, by the crc32 h of its doc_id, repeats itself: with g = h // 10 and n
    words, all from word g % n on are those of a period of 1 + (n - g % n) // (3 + g % 8) words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", words(F.col("text")).alias("ws"), h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((F.col("n") - F.col("a")) / period).cast("int")
    again = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, period), times))
    text = F.array_join(F.slice(F.concat(F.slice("ws", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(planted(table(spark, sf_dir, "documents")))
    longer = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longer)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    again = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(again.cast("binary"), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_packing, op3_minhash, op4_quality_rules, op5_mixing, op6_pii, op7_sharding, op8_quality_classifier, op9_toxicity, op10_language_id,
        op11_best_fit_packing, op12_periodic_runs, op13_fill_in_middle,
    )
}
ORACLES = {"op4_quality_rules": oracles.quality_rules(), "op13_fill_in_middle": oracles.fill_in_middle()}
