"""Spacing, fonts, messages and errors of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, round_half_up

# Fonts by pattern, in order of trial, as Latin and East Asian names.
FONTS = [
    (r"simsun|songti|nsimsun|宋体", "Times New Roman", "宋体"),
    (r"simhei|heiti|黑体", "Arial", "黑体"),
    (r"(?:microsoft\s*)?yahei|msyh|微软雅黑", "Segoe UI", "微软雅黑"),
    (r"simkai|kaiti|楷体", "Times New Roman", "楷体"),
    (r"fangsong|仿宋", "Times New Roman", "仿宋"),
    (r"dengxian|等线", "Calibri", "等线"),
    (r"pingfang|苹方", "Helvetica", "微软雅黑"),
    (r"noto\s*sans\s*(?:sc|cjk)|source\s*han\s*sans", "Arial", "思源黑体"),
    (r"noto\s*serif\s*(?:sc|cjk)|source\s*han\s*serif", "Times New Roman", "思源宋体"),
    (r"times|georgia|garamond|minion|cambria", "Times New Roman", "宋体"),
    (r"arial|helvetica|verdana|tahoma|roboto|open\s*sans|lato", "Arial", "微软雅黑"),
    (r"calibri|segoe", "Calibri", "等线"),
    (r"courier|consol|mono|menlo", "Consolas", "宋体"),
]
MEMORY = r"(?i)out of memory|allocation failed|cannot enlarge memory|invalid array length|wasm memory|memory access out of bounds|\boom\b"


def font(name: Column, family: Column) -> Column:
    """struct(latin, east_asian)."""
    made = lambda latin, east: F.struct(F.lit(latin).alias("latin"), F.lit(east).alias("east_asian"))
    chain = reduce(lambda c, r: c.when(F.coalesce(name, F.lit("")).rlike("(?i)" + r[0]), made(*r[1:])), FONTS[1:], F.when(F.coalesce(name, F.lit("")).rlike("(?i)" + FONTS[0][0]), made(*FONTS[0][1:])))
    kind = F.lower(F.coalesce(family, F.lit("")))
    return chain.when(kind.contains("monospace"), made("Consolas", "宋体")).when(kind.contains("serif") & ~kind.contains("sans"), made("Times New Roman", "宋体")).otherwise(made("Arial", "微软雅黑"))


def clean_font_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\A[A-Z]{6}\+", "")


def clamp_indent(indent: Column, size: Column) -> Column:
    em = F.when(size > 0, size).otherwise(F.lit(10.5))
    return F.when(indent < em * F.lit(0.4), F.lit(0.0)).otherwise(F.least(indent, em * 4))


def line_spacing(pitch: Column, size: Column, largest: Column, lines: Column, page_pitch: Column) -> Column:
    """struct(spacing, rule). pitch: median of the block's positive baseline steps; null where there is none."""
    made = lambda s, r: F.struct(s.cast("double").alias("spacing"), F.lit(r).alias("rule"))
    usual = made(F.lit(1.15), "atLeast")
    borrowed = page_pitch.between(size * F.lit(1.05), size * 2) & (page_pitch > 0)
    spacing = clamp(pitch / size, 0.9, 3.0)
    many = F.when(F.coalesce(pitch, F.lit(0.0)) <= 0, usual).when(pitch >= largest * F.lit(1.05), made(spacing, "exact")).otherwise(made(spacing, "atLeast"))
    return F.when(lines >= 2, many).when(borrowed, made(page_pitch / size, "exact")).otherwise(usual)


def space_after(step: Column, pitch: Column, page_pitch: Column, size: Column) -> Column:
    """Points between text blocks beyond a line's pitch, 0 to 24. step: next first baseline less own last one."""
    usual = F.when(pitch > 0, pitch).when(page_pitch > 0, page_pitch).otherwise(size * F.lit(1.2))
    return F.coalesce(clamp(round_half_up(step - usual), 0, 24), F.lit(0)).cast("int")


def space_after_box(gap: Column, body: Column) -> Column:
    return F.when(gap > 0, clamp(round_half_up(gap - body * F.lit(0.35)), 0, 24)).otherwise(0).cast("int")


def error_code(name: Column, message: Column, aborted: Column) -> Column:
    code = F.when((name == "CancelledError") | aborted, "cancelled").when(name == "PageRangeError", "invalid-page-range")
    code = code.when(name == "PasswordException", F.when(message.rlike("(?i)incorrect"), "password-incorrect").otherwise("password-required"))
    return code.when((name == "InvalidPDFException") | message.rlike("(?i)invalid pdf"), "invalid-pdf").when(message.rlike(MEMORY), "out-of-memory").otherwise("unknown")


def retryable(code: Column) -> Column:
    return code.isin("memory", "crashed", "unknown", "encode")


def clock(ms: Column) -> Column:
    """0:07, 12:34, 1:02:03."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("int")
    h, m, s = F.floor(total / 3600).cast("int"), F.floor(total % 3600 / 60).cast("int"), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def file_size(n: Column) -> Column:
    kb, mb = F.format_string("%.0f KB", n / F.lit(1024.0)), F.format_string("%.1f MB", n / F.lit(1048576.0))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def interpolate(template: Column, parameters: Column) -> Column:
    """{name} replaced by the entry of a map; names that have none stay."""
    return F.aggregate(F.map_entries(parameters), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def page_image_name(base: Column, index: Column, total: Column, extension: str) -> Column:
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return F.concat(base, F.lit("-"), F.lpad((index + 1).cast("string"), width, F.lit("0")), F.lit(f".{extension}"))


def output_name(name: Column, extension: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^./\\]+\z", ""), r'[\\/:*?"<>|]', "_")
    return F.concat(F.when(base == "", "image").otherwise(base), F.lit("."), extension)


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(?s).*/", 0)
