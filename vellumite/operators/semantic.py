"""From layout blocks to semantic ones: sections, page breaks, runs, line pitch, margins, warnings of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import clamp, round_half_up
from .sequences import first_of, islands

SAME_SIZE, GAP, CJK_GAP = 0.26, 0.22, 0.9
RUN = "array<struct<text:string,bold:boolean,italic:boolean,font_size:double,font_name:string>>"


def sections(pages: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Adds `section`, from 1, to pages (width, height): a new one where the rounded size changes; and `break_before`."""
    key = F.concat_ws(":", round_half_up(F.col("width")).cast("string"), round_half_up(F.col("height")).cast("string"))
    numbered = islands(pages.withColumn("_key", key), [doc], [page], lambda prev: F.col("_key") != prev("_key"), "section")
    first = F.row_number().over(Window.partitionBy(doc, "section").orderBy(page)) == 1
    return numbered.withColumn("break_before", ~first).drop("_key")


def line_runs(spans: Column) -> Column:
    """Spans of one line, an array of structs (text, x, w, font_size, bold, italic, font_name) from left to right -> RUN:
    neighbours of one style joined, with spaces where gaps are wide. A span joins a run if its size is within 0.26 points
    of the run's first."""

    def spaced(left: Column, a: Column, b: Column) -> Column:
        em = F.least(a["font_size"], b["font_size"])
        share = F.when(left.rlike(f"[{T.CJK}]\\z") | b["text"].rlike(f"\\A[{T.CJK}]"), CJK_GAP).otherwise(GAP)
        free = (b["x"] - (a["x"] + a["w"])) > em * share
        return free & ~left.rlike(f"[{T.SPACE}]\\z") & ~b["text"].rlike(f"\\A[{T.SPACE}]") & (left != "") & (b["text"] != "")

    def run(x: Column, text: Column, size: Column | None = None) -> Column:
        return F.struct(text.alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"), (x["font_size"] if size is None else size).alias("font_size"), x["font_name"].alias("font_name"))

    def step(state: Column, x: Column) -> Column:
        runs, before = state["runs"], state["before"]
        last = F.element_at(runs, -1)
        text = F.when(before.isNotNull() & spaced(F.coalesce(last["text"], F.lit("")), before, x), F.concat(F.lit(" "), x["text"])).otherwise(x["text"])
        alike = before.isNotNull() & (last["bold"] == x["bold"]) & (last["italic"] == x["italic"]) & last["font_name"].eqNullSafe(x["font_name"]) & (F.abs(last["font_size"] - x["font_size"]) < SAME_SIZE)
        joined = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(run(last, F.concat(last["text"], text))))
        return F.struct(F.when(F.coalesce(alike, F.lit(False)), joined).otherwise(F.concat(runs, F.array(run(x, text)))).cast(RUN).alias("runs"), x.alias("before"))

    start = F.struct(F.array().cast(RUN).alias("runs"), F.when(F.lit(False), F.element_at(spans, 1)).alias("before"))
    return F.filter(F.aggregate(spans, start, step, lambda s: s["runs"]), lambda r: r["text"] != "")


def strip_marker(runs: Column, length: Column) -> Column:
    """RUN without its first `length` characters, which a list marker takes."""
    ends = F.transform(runs, lambda r, i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda n, q: n + F.length(q["text"])))
    cut = F.zip_with(runs, ends, lambda r, before: F.struct(F.substring(r["text"], F.greatest(F.lit(1), length - before + 1), F.length(r["text"])).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["font_size"].alias("font_size"), r["font_name"].alias("font_name")))
    return F.filter(cut, lambda r: r["text"] != "")


def page_pitch(lines: DataFrame, by: Sequence[str] = ("doc_id", "page_index"), block: str = "block") -> DataFrame:
    """by, pitch: the median step between baselines of neighbouring lines of a block; 0 where no block has two lines."""
    step = F.col("baseline") - F.lag("baseline").over(Window.partitionBy(*by, block).orderBy("baseline", "seq"))
    return lines.withColumn("_step", step).groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("_step") > 0, F.col("_step"))), F.lit(0.0)).alias("pitch"))


def page_margins(blocks: DataFrame, by: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """by and the four margins of blocks (x, y, w, h, page_width, page_height), 18 to 108 points each."""
    side = lambda v: clamp(round_half_up(v), 18, 108).cast("double")
    right, low = F.max("page_width"), F.max("page_height")
    return blocks.groupBy(*by).agg(side(F.min("x")).alias("margin_left"), side(F.min("y")).alias("margin_top"), side(right - F.max(F.col("x") + F.col("w"))).alias("margin_right"), side(low - F.max(F.col("y") + F.col("h"))).alias("margin_bottom"))


def section_margins(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, section and its smallest margins over pages with text; 56 on all sides where the page size was clamped, 72
    where no page has text."""
    names = [f"margin_{s}" for s in ("left", "top", "right", "bottom")]
    least = [F.when(F.bool_or("clamped"), 56.0).otherwise(F.coalesce(F.min(F.when(F.col("has_text"), F.col(n))), F.lit(72.0))).alias(n) for n in names]
    return pages.groupBy(doc, "section").agg(*least)


def distinct_warnings(*streams: DataFrame) -> DataFrame:
    """Warnings (doc_id, seq, code, page_index, params) of all streams, the first of each code, page and parameters."""
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return first_of(rows.withColumn("_p", F.to_json("params")), ["doc_id", "code", "page_index", "_p"], ["seq"]).drop("_p")


def split_warnings(warnings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings of pages there are, the rest, which are the document's)."""
    key = ["doc_id", "page_index"]
    return warnings.join(pages.select(*key).distinct(), key, "left_semi"), warnings.join(pages.select(*key).distinct(), key, "left_anti")
