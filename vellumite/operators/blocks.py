"""Paragraph blocks of single-column pages, as windows over lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GAP, SHORT, INDENT, TALLER = 1.55, 2.5, 0.7, 1.12


def paragraph_breaks(lines: DataFrame, by: Sequence[str] = ("doc_id", "page_index"), bold: str | None = None) -> DataFrame:
    """Adds `block`, from 1, to lines (text, x, w, baseline, font_size, seq) of one column a page.

    A line starts a block if it lies far below the one before, or differs in size by over 15 % or in weight, or has a list
    marker, or hangs left of a marked line, or if the line before ended early, or if it is indented after a full line."""
    page, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("baseline", "seq")
    prev = lambda c: F.lag(c).over(w)
    df = lines.withColumn("_left", F.min("x").over(page)).withColumn("_right", F.max(F.col("x") + F.col("w")).over(page))
    df = df.withColumn("_gap", F.col("baseline") - prev("baseline")).withColumn("_marked", T.list_marker(F.col("text")).isNotNull())
    # the gap of nearest rank 0.3, found by its place among the page's gaps above 0
    df = df.withColumn("_pos", F.when(F.col("_gap") > 0, F.col("_gap")))
    df = df.withColumn("_n", F.count("_pos").over(page)).withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_pos").asc_nulls_last())))
    base = F.max(F.when(F.col("_rank") == F.floor((F.col("_n") - 1) * F.lit(0.3) + F.lit(0.5)) + 1, F.col("_pos"))).over(page)
    df = df.withColumn("_base", F.coalesce(base, F.median("font_size").over(page) * F.lit(1.2)))
    em = F.least(F.col("font_size"), prev("font_size"))
    reach = F.col("_right") - em * SHORT
    early = prev(F.col("x") + F.col("w")) < reach
    short = F.col("x") + F.col("w") < reach
    indented = F.col("x") > F.col("_left") + em * F.lit(INDENT)
    hanging = prev("_marked") & (F.col("x") < prev("x") - em * F.lit(INDENT)) & (early | short)
    end, cjk = prev(T.ends_sentence(F.col("text"))), prev(T.contains_cjk(F.col("text")))
    starts = (F.col("_gap") > F.col("_base") * F.lit(GAP) + 1) | (F.abs(F.col("font_size") - prev("font_size")) > em * F.lit(0.15)) | F.col("_marked") | hanging | (early & ~indented & end) | (early & cjk) | (indented & ~early)
    if bold:
        starts = starts | (F.col(bold) != prev(bold))
    df = df.withColumn("_begin", F.coalesce(starts, F.lit(True)).cast("int"))
    return df.withColumn("block", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_base", "_begin", "_pos", "_n", "_rank")


def classify_blocks(lines: DataFrame, body_size: float, by: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """Lines with `block` -> by, block, kind (paragraph, heading, list-item), level, lines, characters, text.

    Clean pages only: sizes are trusted, and headings are told by size, or by a section number with some size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    first = F.min_by("x", "seq")
    df = lines.groupBy(*by, "block").agg(ordered.alias("_lines"), F.median("font_size").alias("_size"), F.count("*").alias("lines"), F.sum(T.utf16_length(F.col("text"))).alias("characters"), first.alias("_x"), F.min("_left").alias("_left"), F.min_by("font_size", "seq").alias("_first"))
    df = df.withColumn("_text", T.trimmed(F.array_join("_lines", " "))).withColumn("_marker", T.list_marker(F.element_at("_lines", 1)))
    ratio = F.col("_size") / F.lit(float(body_size))
    depth, cjk = T.section_depth(F.col("_text")), T.cjk_section_level(F.col("_text"))
    fits = (F.col("lines") <= 3) & T.utf16_length(F.col("_text")).between(1, 120)
    by_size = (ratio >= F.lit(TALLER)) & ((F.col("lines") == 1) | (ratio >= F.lit(1.25))) & ~F.col("_text").rlike(r"[，、,]\z")
    is_heading = fits & (by_size | (depth.isNotNull() & (ratio >= F.lit(1.05))))
    level = F.when(depth.isNotNull(), F.least(F.lit(4), depth)).when(cjk.isNotNull() & (ratio < F.lit(1.4)), cjk).when(ratio >= F.lit(1.7), 1).when(ratio >= F.lit(1.4), 2).when(ratio >= F.lit(1.18), 3).otherwise(4)
    numbered = is_heading & (T.cjk_section_level(F.element_at("_lines", 1)) == 2)
    listed = F.col("_marker").isNotNull() & (F.col("lines") <= 6) & ~(is_heading & (ratio >= F.lit(TALLER))) & ~F.coalesce(numbered, F.lit(False))
    indent = F.greatest(F.lit(0.0), F.col("_x") - F.col("_left"))
    list_level = F.least(F.lit(4), F.floor(indent / F.greatest(F.col("_first") * F.lit(1.4), F.lit(8.0))).cast("int"))
    kind = F.when(listed, "list-item").when(is_heading, "heading").otherwise("paragraph")
    return df.select(*by, "block", kind.alias("kind"), F.when(listed, list_level).when(is_heading, level).alias("level"), "lines", "characters", F.col("_text").alias("text"))


def page_report(blocks: DataFrame, by: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k.replace("-", "_") + "s")
    return blocks.groupBy(*by).agg(count("paragraph"), count("heading"), count("list-item"), F.sum("characters").alias("characters"))

