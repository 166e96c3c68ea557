"""Pages out of a flow: where what was set in columns lies on its page, with heads and feet on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in points: between columns, between a head or foot and the body, the least height of a body.
COLUMN_GAP, BAND_GAP, LEAST_BODY = 48.0, 6.0, 72.0


def content_box(width: Column, height: Column, margins: dict[str, Column], head: Column, foot: Column, head_at: Column, foot_at: Column) -> Column:
    """struct(left, top, width, height) of a page's body. Heads and feet that don't fit in the margins push it inwards; a
    height of 0 is none."""
    pushed = lambda margin, at, size: F.greatest(margin, F.when(size > 0, at + size + BAND_GAP).otherwise(0.0))
    top, bottom = pushed(margins["top"], head_at, head), pushed(margins["bottom"], foot_at, foot)
    return F.struct(margins["left"].cast("double").alias("left"), top.cast("double").alias("top"), (width - margins["left"] - margins["right"]).cast("double").alias("width"), F.greatest(F.lit(LEAST_BODY), height - top - bottom).cast("double").alias("height"))


def columns_of(flow: DataFrame, sections: DataFrame, by: str, y: str, h: str) -> DataFrame:
    """flow (by, y and h in one endless column) with column and at (the place in it): as high as its section's body.

    An op that doesn't fit below the others of its column begins the next; one higher than a column is cut by it. Ops
    are placed by where they begin: no fold, so a break can leave some room at the end of a column."""
    rows = flow.join(sections.select(F.col(by).alias("_by"), F.col("body.height").alias("_height")), F.col(by) == F.col("_by"))
    column = F.floor(F.col(y) / F.col("_height"))
    at = F.col(y) - column * F.col("_height")
    over = (at > 0) & (at + F.col(h) > F.col("_height"))
    return rows.withColumn("column", (column + over.cast("int")).cast("int")).withColumn("at", F.when(over, 0.0).otherwise(at)).drop("_by", "_height")


def paginate(ops: DataFrame, bands: DataFrame, sections: DataFrame, by: str, gap: float = COLUMN_GAP) -> DataFrame:
    """by, page (from 0), part (head, foot or body), seq, x, y, from the upper left corner of a page.

    sections: by, height, head_at, foot_at, foot_height and body (content_box). ops: by, seq, x and y in columns set side by
    side, `gap` apart, as wide as the body; an op that begins up to a point left of a column belongs to it. bands: by, part,
    seq, x, y in their band, repeated on each page. A section has a page at least. Bands are repeated by a sequence of its
    page numbers."""
    known = sections.select(F.col(by).alias("_by"), "height", "head_at", "foot_at", "foot_height", "body")
    pitch = F.col("body.width") + F.lit(gap)
    placed = ops.join(known, F.col(by) == F.col("_by"))
    page = F.greatest(F.lit(0), F.floor((F.col("x") + 1) / pitch)).cast("int")
    body = placed.select(by, page.alias("page"), F.lit("body").alias("part"), F.col("seq").cast("long").alias("seq"), (F.col("x") - page * pitch + F.col("body.left")).alias("x"), (F.col("y") + F.col("body.top")).alias("y"))
    counts = body.groupBy(F.col(by).alias("_of")).agg((F.max("page") + 1).alias("_pages"))
    paged = known.join(counts, F.col("_by") == F.col("_of"), "left").withColumn("_pages", F.coalesce("_pages", F.lit(1)))
    top = F.when(F.col("part") == "head", F.col("head_at")).otherwise(F.col("height") - F.col("foot_at") - F.col("foot_height"))
    each = bands.join(paged, F.col(by) == F.col("_by")).withColumn("page", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1)))
    repeated = each.select(by, "page", "part", F.col("seq").cast("long").alias("seq"), (F.col("x") + F.col("body.left")).alias("x"), (F.col("y") + top).alias("y"))
    return repeated.unionByName(body)
