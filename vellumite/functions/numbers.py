"""Numbers: rounding half up towards +infinity, clamping, units, page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp_int(x: Column, low: int, high: int, otherwise: int) -> Column:
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(round_half_up(x), F.lit(low)), F.lit(high))).otherwise(F.lit(otherwise)).cast("int")


def pt_to_twip(x: Column) -> Column:
    return round_half_up(x * 20)


def pt_to_half_point(x: Column) -> Column:
    return F.greatest(F.lit(2), round_half_up(x * 2))


def pt_to_emu(x: Column) -> Column:
    return round_half_up(x * 12700)


def pt_to_px96(x: Column) -> Column:
    return round_half_up(x * F.lit(4.0) / 3)


def px96_to_pt(x: Column) -> Column:
    return x * F.lit(0.75)


def nearest_rank(values: Column, p: float) -> Column:
    """The value at position round_half_up((n - 1) * p) of the sorted array; 0 for an empty one."""
    at = round_half_up((F.size(values) - 1) * F.lit(float(p))).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(0.0))


PAGE_SEPARATORS = r"[,，、;；\s]+"
PAGE_TOKEN = r"\A(?:[0-9]+[-–—~]?[0-9]*|[-–—~][0-9]+)\z"
LARGEST = 9007199254740991


def page_range_valid(text: Column) -> Column:
    """Whether a page range is well formed; blank counts as such (all pages)."""
    tokens = F.filter(F.split(F.trim(text), PAGE_SEPARATORS), lambda t: t != "")

    def number_fine(n: Column) -> Column:
        return F.coalesce(n.try_cast("decimal(38,0)").between(1, LARGEST), F.lit(False))

    each = F.forall(tokens, lambda t: t.rlike(PAGE_TOKEN) & F.forall(F.filter(F.split(t, "[-–—~]"), lambda n: n != ""), number_fine))
    return (F.trim(text) == "") | ((F.size(tokens) > 0) & each)


def page_range(text: Column, total: Column) -> Column:
    """Page range text -> sorted array of 0-based pages; empty array for blank text, null where nothing is picked or the
    text is malformed. Closed ranges may be given backwards; open ones (`8-`, `-4`) run to the ends."""
    tokens = F.filter(F.split(F.trim(text), PAGE_SEPARATORS), lambda t: t != "")

    def pages(t: Column) -> Column:
        first, dash = F.regexp_extract(t, r"\A[0-9]*", 0), t.rlike("[-–—~]")
        second = F.when(dash, F.regexp_extract(t, r"[0-9]*\z", 0)).otherwise("")
        start = F.when(first == "", F.lit(1).cast("long")).otherwise(first.cast("long"))
        end = F.when(~dash, start).when(second == "", total.cast("long")).otherwise(second.cast("long"))
        swap = (start > end) & (second != "")
        low, high = F.when(swap, end).otherwise(start), F.least(F.when(swap, start).otherwise(end), total.cast("long"))
        return F.when(low <= high, F.sequence(low - 1, F.greatest(high - 1, low - 1))).otherwise(F.array().cast("array<bigint>"))

    picked = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))
    return F.when(F.trim(text) == "", F.array().cast("array<bigint>")).when(page_range_valid(text) & (total >= 1) & (F.size(picked) > 0), picked)
