"""Synthetic pages from plain texts: one span a line, 45 lines a page, A4, one size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LINES, TOP, LEFT, PITCH, SIZE, ADVANCE = 45, 90.0, 72.0, 15.0, 10.5, 0.55


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page_index, n (line of the page), seq (line of the text), text, x, y, w, h, baseline, font_size; lines that
    are blank have no span. A narrow generate: no shuffle."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("seq", "text")).where(F.col("text").rlike(f"[^{T.SPACE}]"))
    n = F.col("seq") % LINES
    indent = F.length("text") - F.length(F.ltrim("text"))
    baseline = F.lit(TOP) + F.lit(PITCH) * n
    advance = F.lit(SIZE * ADVANCE)
    return lines.select(
        key, F.floor(F.col("seq") / LINES).cast("int").alias("page_index"), n.cast("int").alias("n"), "seq", "text",
        (F.lit(LEFT) + indent * advance).alias("x"), (baseline - F.lit(0.8 * SIZE)).alias("y"), ((F.length("text") - indent) * advance).alias("w"), F.lit(SIZE).alias("h"), baseline.alias("baseline"), F.lit(SIZE).alias("font_size"),
    )
