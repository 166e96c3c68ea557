"""Aggregates: modes by bucket, weighted medians, nearest-rank percentiles, size unification, text health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import nearest_rank, round_half_up


def mode_by_bucket(df: DataFrame, by: Sequence[str], value: str, bucket: float = 0.5, weight: Column | None = None) -> DataFrame:
    """by, mode, weight: the bucket with most weight (1 a row by default), the smaller one on ties. Two partial
    aggregations; a group's rows never meet in one task."""
    key = (round_half_up(F.col(value) / F.lit(float(bucket))) * F.lit(float(bucket))).alias("_key")
    summed = df.groupBy(*by, key).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_w"))
    return summed.groupBy(*by).agg(F.max_by("_key", F.struct("_w", -F.col("_key"))).alias("mode"), F.max("_w").alias("weight"))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """by, median: the first value, in order, at which the running weight reaches half of the total.

    Rows of one value are summed first, so that the window runs over distinct values."""
    summed = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by)
    running = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    marked = summed.withColumn("_run", running).withColumn("_all", F.sum("_w").over(w))
    return marked.where(F.col("_run") >= F.col("_all") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def percentile_nearest(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """by, value_at: the value at rank round_half_up((n - 1) * p). Values are counted first; ranks run over distinct ones."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    return ranked.where(F.col("_upto") > round_half_up((F.col("_all") - 1) * F.lit(float(p)))).groupBy(*by).agg(F.min(value).alias("value_at"))


def percentile_of_array(values: Column, p: float) -> Column:
    return nearest_rank(values, p)


def snap_sizes(df: DataFrame, by: Sequence[str], size: str, weight: str) -> DataFrame:
    """Adds `dominant` (the weighted median) and `snapped`: sizes within 35 % become dominant, those over three times it
    become three times it."""
    dominant = weighted_median(df, by, size, weight).withColumnRenamed("median", "dominant")
    ratio = F.col(size) / F.col("dominant")
    snapped = F.when(F.abs(ratio - 1) < F.lit(0.35), F.col("dominant")).when(ratio > 3, F.col("dominant") * 3).otherwise(F.col(size))
    return df.join(dominant, list(by)).withColumn("snapped", snapped)


def unify_sizes(df: DataFrame, doc: str, page: str, size: str, weight: str, near: float = 0.2) -> DataFrame:
    """Adds `unified`: a page's dominant size becomes the document's where they differ by less than `near`, for spans of
    exactly that size."""
    page_size = weighted_median(df, [doc, page], size, weight).withColumnRenamed("median", "_page")
    weights = df.groupBy(doc, page).agg(F.sum(weight).alias("_w"))
    doc_size = weighted_median(page_size.join(weights, [doc, page]), [doc], "_page", "_w").withColumnRenamed("median", "_doc")
    joined = df.join(page_size, [doc, page]).join(doc_size, doc)
    take = (F.abs(F.col("_page") / F.col("_doc") - 1) < F.lit(near)) & (F.col(size) == F.col("_page"))
    return joined.withColumn("unified", F.when(take, F.col("_doc")).otherwise(F.col(size))).drop("_page", "_doc")


def text_health(text: Column, image_coverage: Column | None = None) -> Column:
    """struct(chars, printable_ratio, replacement_ratio, suspicious) of a page's text."""
    # no branches: so the count is made once for all that use it
    chars, broken = F.length(text), T.broken_count(text)
    some = F.greatest(chars, F.lit(1))
    replacement, printable = broken / some, (chars - broken) / some
    suspicious = (replacement > F.lit(0.12)) | ((chars > 20) & (printable < F.lit(0.7)))
    return F.struct(chars.alias("chars"), printable.alias("printable_ratio"), replacement.alias("replacement_ratio"), suspicious.alias("suspicious"))


def running_budget(df: DataFrame, by: Sequence[str], order: str, size: str, budget: int, block: int = 10_000) -> DataFrame:
    """Adds `kept`: rows of a group, in the order of a whole-number column, are taken until the total of those before
    reaches the budget. Null orders come first, null sizes count as 0.

    Totals run over blocks of `block` numbers, then inside each: no group of rows meets in one task, whatever its size."""
    place = F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62)).cast("long"))
    rows = df.withColumn("_block", place)
    sums = rows.groupBy(*by, "_block").agg(F.sum(size).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_b"), ahead.alias("_ahead"))
    same = F.col("_block") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, same).withColumn("kept", F.col("_ahead") + inside < budget).select(*df.columns, "kept")
