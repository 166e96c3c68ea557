"""Lines that repeat across a document's pages: running heads and feet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sequences import islands

BAND, SPREAD = 0.11, 20.0


def repeated_lines(lines: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Lines (doc, page, line_id, text, x, y, w, h, page_width, page_height, rotated) that are running heads or feet, with
    `band`. A line counts if its text, numbers aside, stands in the same band of enough distinct pages, and at one height.

    Documents of fewer than three pages have none. Enough: half of the pages, two at least; three for rotated side lines."""
    cy, cx = F.col("y") + F.col("h") / 2, F.col("x") + F.col("w") / 2
    side = F.col("rotated") & ((cx < F.col("page_width") * BAND) | (cx > F.col("page_width") * (1 - BAND)))
    band = F.when(side, "side").when(cy < F.col("page_height") * BAND, "header").when(cy > F.col("page_height") * (1 - BAND), "footer")
    found = lines.withColumn("band", band).withColumn("_cy", cy).where(F.col("band").isNotNull() & (T.trimmed(F.col("text")) != ""))
    found = found.withColumn("_key", F.when(T.is_page_number(F.col("text")), "<pageno>").otherwise(T.repeat_key(F.col("text"))))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages")).where("_pages >= 3")
    half = F.greatest(F.lit(2), F.ceil(F.col("_pages") / 2))
    needed = F.when(F.col("band") == "side", F.least(half, F.lit(3))).otherwise(half)
    key = [doc, "band", "_key"]
    enough = found.groupBy(*key).agg(F.count_distinct(page).alias("_n")).join(pages, doc).where(F.col("_n") >= needed).select(*key, needed.alias("_needed"))
    placed = islands(found.join(enough, key), key, ["_cy", page, "line_id"], lambda prev: F.col("_cy") - prev("_cy") > SPREAD, "_spot")
    spot = [*key, "_spot"]
    # distinct pages of a place: the last of their dense ranks
    placed = placed.withColumn("_page_rank", F.dense_rank().over(Window.partitionBy(*spot).orderBy(page)))
    return placed.withColumn("_there", F.max("_page_rank").over(Window.partitionBy(*spot))).where("_there >= _needed").select(*lines.columns, "band")


def without(lines: DataFrame, running: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """The lines of pages' bodies: those (doc, page, line_id) that are no running head or foot."""
    return lines.join(running.select(doc, page, "line_id"), [doc, page, "line_id"], "left_anti")


def furniture(running: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """doc, page, part (head or foot), lines, x, y, w, h, text: what a page has of running lines, those beside the text in
    the head, as lines from top to bottom and left to right."""
    part = F.when(F.col("band") == "footer", "foot").otherwise("head")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "line_id", "text"))), lambda s: s["text"])
    boxed = running.groupBy(doc, page, part.alias("part")).agg(F.count("*").alias("lines"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.array_join(texts, "\n").alias("text"))
    return boxed.select(doc, page, "part", "lines", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "text")
