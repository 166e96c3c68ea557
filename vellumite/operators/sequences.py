"""Ordered sequences as windows: gaps and islands, interval merging, numbering, sliding samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], starts, into: str = "island") -> DataFrame:
    """Adds the number, from 1, of the run that a row lies in; starts(previous) tells, given a function from a column's
    name to its value in the row before, whether a row begins a new run."""
    w = Window.partitionBy(*by).orderBy(*order)
    begin = F.coalesce(starts(lambda c: F.lag(c).over(w)), F.lit(True))
    return df.withColumn("_begin", begin.cast("int")).withColumn(into, F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


def cluster_1d(df: DataFrame, by: Sequence[str], value: str, tolerance: float, tie: str) -> DataFrame:
    """by, cluster, value (mean), members: values in order, a new cluster where the step exceeds the tolerance."""
    run = islands(df, by, [value, tie], lambda prev: F.col(value) - prev(value) > F.lit(tolerance), "cluster")
    return run.groupBy(*by, "cluster").agg(F.avg(value).alias("center"), F.count("*").alias("members"))


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, slack: float = 0.0, tie: Sequence[str] = ()) -> DataFrame:
    """by, part, start, end, members: unions of intervals that overlap or lie within slack."""
    w = Window.partitionBy(*by).orderBy(start, end, *tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_begin", F.coalesce(F.col(start) > reach + F.lit(slack), F.lit(True)).cast("int"))
    numbered = marked.withColumn("part", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def find_gaps(df: DataFrame, by: Sequence[str], start: str, end: str, tie: Sequence[str] = ()) -> DataFrame:
    """by, gap_from, gap_to: what no interval covers between the first and the last."""
    w = Window.partitionBy(*by).orderBy(start, end, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("gap_from", F.max(end).over(w)).where(F.col(start) > F.col("gap_from")).select(*by, "gap_from", F.col(start).alias("gap_to"))


def unique_names(df: DataFrame, by: Sequence[str], name: str, order: Sequence[str], into: str = "unique_name") -> DataFrame:
    """The k-th row of a name gets " (k)" before its extension, from the second on."""
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    dot = F.length(name) - F.length(F.substring_index(F.col(name), ".", -1))
    split = F.when((dot > 1) & F.col(name).contains("."), dot - 1).otherwise(F.length(name))
    numbered = F.concat(F.substring(F.col(name), F.lit(1), split), F.lit(" ("), k.cast("string"), F.lit(")"), F.substring(F.col(name), split + 1, F.length(name)))
    return df.withColumn(into, F.when(k > 1, numbered).otherwise(F.col(name)))


def format_ranges(df: DataFrame, by: Sequence[str], index: str, into: str = "ranges") -> DataFrame:
    """by, `into`: 0-based indices as text, 1-based, runs as `from-to`."""
    distinct = df.select(*by, index).distinct()
    run = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    runs = distinct.withColumn("_run", run).groupBy(*by, "_run").agg((F.min(index) + 1).alias("_from"), (F.max(index) + 1).alias("_to"))
    one = F.when(F.col("_from") == F.col("_to"), F.col("_from").cast("string")).otherwise(F.concat_ws("-", F.col("_from").cast("string"), F.col("_to").cast("string")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_from", one.alias("t")))), lambda s: s["t"])
    return runs.groupBy(*by).agg(F.array_join(joined, ", ").alias(into))


def sample_window(df: DataFrame, by: Sequence[str], seconds: str, order: Sequence[str], span: int = 60, least: int = 4, most: int = 600) -> DataFrame:
    """Adds `samples`: how many rows a sliding buffer holds after each: those of the last `span` seconds, but `least` at
    least and `most` at most."""
    in_time = F.count("*").over(Window.partitionBy(*by).orderBy(seconds).rangeBetween(-span, 0))
    so_far = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("samples", F.least(so_far, F.greatest(in_time, F.lit(least)), F.lit(most)))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each combination of keys."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def hierarchical_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, depth: int) -> DataFrame:
    """Adds `label`: counters of levels 0 .. level, joined by dots, with a dot after a lone one. A counter starts over
    after each item of a smaller level; one count and one island per level, no fold."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for k in range(depth):
        df = df.withColumn(f"_i{k}", F.sum((F.col(level) < k).cast("int")).over(w))
    for k in range(depth):
        inner = Window.partitionBy(*by, f"_i{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"_c{k}", F.sum((F.col(level) == k).cast("int")).over(inner))
    parts = F.slice(F.array(*[F.col(f"_c{k}").cast("string") for k in range(depth)]), F.lit(1), F.col(level).cast("int") + 1)
    label = F.concat(F.array_join(parts, "."), F.when(F.col(level) == 0, ".").otherwise(""))
    return df.withColumn("label", label).drop(*[f"_{x}{k}" for x in "ic" for k in range(depth)])


def page_numbers(lines: DataFrame, by: str, page: str, text: str = "text") -> DataFrame:
    """by, page, position, value, is_page_number: numbers of a running line that change between its variants.

    Numbers are compared place by place among the lines with equally many; a lone line has a page number only if it is
    nothing else."""
    found = lines.withColumn("_ns", F.regexp_extract_all(text, F.lit("([0-9]{1,4})"), F.lit(1)))
    each = found.select(by, page, F.size("_ns").alias("_k"), text, F.posexplode("_ns").alias("position", "value"))
    varied = each.groupBy(by, "_k", "position").agg((F.count_distinct("value") > 1).alias("_varied"))
    alone = lines.groupBy(by).agg((F.count("*") == 1).alias("_alone"))
    joined = each.join(varied, [by, "_k", "position"]).join(alone, by)
    pure = F.col(text).rlike(r"\A[-—–\s]*[0-9]{1,4}[-—–\s]*\z")
    return joined.select(by, page, F.col("position").cast("long").alias("position"), "value", F.when(F.col("_alone"), pure).otherwise(F.col("_varied")).alias("is_page_number"))
