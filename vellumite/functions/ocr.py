"""Recognized text: when to recognize a page, and what to make of the result. Columns of page and span rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import weighted_median
from . import text as T
from .numbers import clamp

# Fixed values.
EDGE, FEW_CHARS, SOME_CHARS = 0.08, 24, 300
A4 = (595.28, 841.89)
WORD_PAGE, STRIP, BODY, LEAST_BODY, NEAR_SIZE = 1584.0, 2.0, 10.5, 8.0, 0.3
STRIP_HEIGHT, STRIP_STEP, STRIP_FROM = 720, 690, 1080
BULLET_GLYPH = r"\A[oO0°º◦∘·•・。]\z"


def should_recognize(policy: str, chars: Column, coverage: Column, suspicious: Column, decorative: Column) -> Column:
    """decorative: the page has spans, and all are rotated or at its upper or lower edge."""
    if policy in ("off", "force"):
        return F.lit(policy == "force")
    return ((chars == 0) & (coverage > F.lit(0.1))) | ((chars < FEW_CHARS) & (coverage > F.lit(0.35))) | ((coverage > F.lit(0.6)) & (chars < SOME_CHARS) & decorative) | suspicious


def decorative_pages(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, decorative: whether all spans (y, h, rotation, page_height) are rotated or in the edge bands."""
    edge = (F.col("y") + F.col("h") <= F.col("page_height") * F.lit(EDGE)) | (F.col("y") >= F.col("page_height") * F.lit(1 - EDGE))
    return spans.groupBy(*by).agg(F.bool_and((F.col("rotation") != 0) | edge).alias("decorative"))


def sparse(lengths: Column) -> Column:
    """Whether an array of trimmed span lengths is a few labels: under 40 characters, or under 300 with an upper median of
    at most 6."""
    some = F.array_sort(F.filter(lengths, lambda n: n > 0))
    total = F.aggregate(some, F.lit(0).cast("long"), lambda a, n: a + n)
    median = F.get(some, F.floor(F.size(some) / 2).cast("int"))
    return (total < 40) | ((total < SOME_CHARS) & (median <= 6))


def rotated(rotation: Column, vertical: Column) -> Column:
    return vertical | rotation.between(1, 359)


def noise(chars: Column, confidence: Column, turned: Column, red: Column, ink: Column) -> Column:
    """Short and doubtful, short and rotated, or red and doubtful or rotated. turned: rotated where few spans are."""
    short = chars <= 4
    stamp = (ink > 0) & (red >= F.lit(0.6))
    return (short & (confidence < F.lit(0.55))) | (short & turned) | (F.coalesce(stamp, F.lit(False)) & ((confidence < F.lit(0.8)) | turned))


def bold_by_ink(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds `bold` to spans (density, ink, chars, cjk, rotated): density at least 1.3 times the page's usual one, which is
    the median of lines with four CJK characters or, with under five such, of all with four characters."""
    page = Window.partitionBy(*by)
    usable = (F.col("density") > 0) & (F.col("chars") >= 4) & ~F.col("rotated")
    cjk, every = F.when(usable & (F.col("cjk") >= 4), F.col("density")), F.when(usable, F.col("density"))
    many = F.count(cjk).over(page) >= 5
    usual = F.when(many, F.median(cjk).over(page)).when(F.count(every).over(page) >= 5, F.median(every).over(page))
    is_bold = (F.col("ink") >= 100) & (F.col("chars") >= 3) & ~F.col("rotated") & (F.col("density") >= usual * F.lit(1.3))
    return spans.withColumn("bold", F.coalesce(is_bold, F.lit(False)))


def font_size(text: Column, width: Column, height: Column, vertical: Column) -> Column:
    """A span's size from its width, in units that characters take, where it has four CJK characters and six units."""
    classes = [(f"[{T.CJK}]", 1.0), (" ", 0.3), ("[A-Z]", 0.67), ("[a-z0-9]", 0.55), ("[\\x{2010}-\\x{206F}\\x{2500}-\\x{27BF}]", 1.0)]
    counts = [(F.regexp_count(text, F.lit(p)), u) for p, u in classes]
    rest = F.length(text)
    units = F.lit(0.0)
    for n, u in counts:
        rest, units = rest - n, units + n * F.lit(u)
    units = units + rest * F.lit(0.5)
    by_width = F.greatest(F.lit(1.0), width / units)
    return F.when(vertical, F.greatest(F.lit(1.0), width) * F.lit(0.9)).when((counts[0][0] < 4) | (units < 6), height * F.lit(0.9)).otherwise(by_width)


def mark_bullets(spans: DataFrame, by: Sequence[str], key: str = "seq") -> DataFrame:
    """Tiny round glyphs at the start of a row, with text close by, become "• " in that text's size and confidence."""
    dominant = weighted_median(spans.withColumn("_n", F.length(T.trimmed(F.col("text")))), by, "font_size", "_n").withColumnRenamed("median", "_dominant")
    d = spans.join(dominant, list(by), "left")
    tiny = d.where(T.trimmed(F.col("text")).rlike(BULLET_GLYPH) & (F.col("font_size") < F.col("_dominant") * F.lit(0.6)))
    other = spans.select(*by, *[F.col(c).alias(f"_o_{c}") for c in (key, "x", "y", "h", "font_size", "confidence")])
    cy = F.col("y") + F.col("h") / 2
    row = tiny.join(other, list(by)).where((F.col(key) != F.col(f"_o_{key}")) & (F.col("_o_y") <= cy) & (F.col("_o_y") + F.col("_o_h") >= cy))
    right = F.col("x") + F.col("w")
    after = F.when(F.col("_o_x") >= right, F.struct("_o_x", f"_o_{key}", "_o_font_size", "_o_confidence"))
    near = row.groupBy(*by, key).agg(F.bool_or(F.col("_o_x") < F.col("x")).alias("_left"), F.min(after).alias("_next"), F.max(right).alias("_right"))
    near = near.where(~F.col("_left") & (F.col("_next._o_x") - F.col("_right") <= F.col("_next._o_font_size") * 3)).select(*by, key, "_next")
    out = spans.join(near, [*by, key], "left")
    hit = F.col("_next").isNotNull()
    return out.select(*by, key, *[F.when(hit, v).otherwise(F.col(c)).alias(c) if v is not None else F.col(c) for c in spans.columns if c not in (*by, key) for v in [{"text": F.lit("• "), "font_size": F.col("_next._o_font_size"), "confidence": F.col("_next._o_confidence")}.get(c)]])


def strips(height: Column) -> Column:
    """Array of structs (top, height): a tall page in overlapping strips, a page of usual height in one."""
    tops = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((height - STRIP_HEIGHT) / F.lit(float(STRIP_STEP))).cast("int") * STRIP_STEP), F.lit(STRIP_STEP))
    cut = F.transform(tops, lambda t: F.struct(t.cast("double").alias("top"), F.least(F.lit(float(STRIP_HEIGHT)), height - t).alias("height")))
    return F.when(height <= STRIP_FROM, F.array(F.struct(F.lit(0.0).alias("top"), height.cast("double").alias("height")))).otherwise(cut)


def image_strips(y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Array of structs (y, h): a tall scan on a tall page in parts 1.3 times as high as wide, at most 1000."""
    part = F.greatest(w * F.lit(1.3), h / 1000)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(h / part).cast("int") - 1), lambda i: F.struct((y + i * part).alias("y"), F.least(part, h - i * part).alias("h")))
    whole = F.array(F.struct(y.cast("double").alias("y"), h.cast("double").alias("h")))
    return F.when((page_h > page_w * 2) & (w > 0) & (h > w * 2), cut).otherwise(whole)


def page_scale(w: Column, h: Column, body: Column, scanned: Column) -> Column:
    """By how much a scan is scaled to come near A4 and a readable body size; 1 within a tenth of it."""
    settle = lambda k: F.when(F.abs(k - 1) < F.lit(0.1), F.lit(1.0)).otherwise(k)
    target = F.when(w > h, A4[1]).otherwise(A4[0])
    k = target / w
    k = F.when((body > 0) & (body * k < LEAST_BODY), F.lit(LEAST_BODY) / body).otherwise(k)
    k = F.when((body > 0) & (k > 1), F.least(k, F.lit(BODY) / body)).otherwise(k)
    tall = F.when(body <= 0, F.lit(1.0)).otherwise(settle(F.lit(BODY) / body))
    near = F.abs(w - target) <= target * F.lit(NEAR_SIZE)
    return F.when(~scanned, F.lit(1.0)).when(h / w > STRIP, tall).when(near, F.lit(1.0)).otherwise(settle(k))


def word_page(w: Column, h: Column) -> Column:
    """struct(width, height, clamped) within Word's largest page: long strips become A4, posters shrink."""
    fits = (w <= WORD_PAGE) & (h <= WORD_PAGE)
    strip = (h > WORD_PAGE) & ((w <= F.lit(A4[0] * 1.05)) | (h / w > STRIP))
    k = F.lit(WORD_PAGE) / F.greatest(w, h)
    side = lambda v, a4: F.when(fits, v).when(strip, a4).otherwise(v * k).cast("double")
    return F.struct(side(w, A4[0]).alias("width"), side(h, A4[1]).alias("height"), (~fits).alias("clamped"))


def item_box(points: Column, scale: Column) -> Column:
    """struct(x, y, w, h, baseline) of a recognized quadrangle, an array of arrays (x, y) in pixels."""
    xs, ys = F.transform(points, lambda p: p[0] / scale), F.transform(points, lambda p: p[1] / scale)
    h = F.array_max(ys) - F.array_min(ys)
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), h.alias("h"), (F.array_max(ys) - h * F.lit(0.2)).alias("baseline"))


def confidence(score: Column) -> Column:
    return clamp(score, 0.0, 1.0)
