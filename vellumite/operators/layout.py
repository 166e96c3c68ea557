"""The layout chain: spans of a page to lines, lines to regions, regions to blocks, blocks to what a writer needs.

One shuffle brings a document's spans together; after it nothing moves. The document's body size is a window over them,
then a page becomes one row with its spans as an array. Lines, columns and regions, which are folds and recursion, are
made from that array in Arrow batches; everything behind (where paragraphs break, what kind a block is, how far apart
blocks lie) are expressions over the arrays of the page's row, since an explode and a window would shuffle again."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as T
from ..functions.numbers import round_half_up
from .pages import LINE_COLUMNS, PAGE, lines_of, regions

# Fixed values, in em or as ratios, as named; those of scans are wider, since boxes and sizes of recognized text shake.
GAP, SLACK, SCAN_SLACK, INDENT, SIZE_STEP = 1.55, 2.5, 3.5, 0.7, 0.15
LARGER, SCAN_LARGER, MUCH_LARGER, NEAR_TEXT = 1.12, 1.35, 1.25, 0.12
USUAL_SIZE, NATIVE_SAMPLE, SPAN_CHARS, LONG_LINE, TEXT_LINES = 10.5, 300, 40, 15, 3
BOLD_SHARE, SAME_ROW, WIDE_REGION, SCAN_SURE = 0.6, 0.5, 0.55, 0.59

LINE = "struct<region:int,text:string,x:double,y:double,w:double,h:double,baseline:double,font_size:double,largest:double,bold:boolean,sibling:boolean,left:double,right:double,base:double>"
PAGE_LINES = f"struct<confidence:double,columns:int,dominant:double,text_sizes:array<double>,lines:array<{LINE}>>"
_LINE = [c.split(":")[0] for c in LINE[7:-1].split(",")]


def _overlaps(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Overlap of each two intervals over the shorter one."""
    common = np.minimum(a1[:, None], a1[None]) - np.maximum(a0[:, None], a0[None])
    shorter = np.minimum((a1 - a0)[:, None], (a1 - a0)[None])
    return np.divide(np.clip(common, 0, None), shorter, out=np.zeros_like(common), where=shorter > 0)


def column_count(boxes: Sequence[tuple[float, float, int]], page_width: float, gap: float, bands: Sequence[tuple[float, float]]) -> int:
    """Columns of a page by its regions (left, right, lines): a new one begins `gap` or a known gutter past all before."""
    wide = sum(b - a > page_width * WIDE_REGION for a, b, _ in boxes)
    spans = sorted((a, b) for a, b, n in boxes if n >= 2)
    if not spans or (wide and len(boxes) <= wide + 1):
        return 1
    count, reach = 1, spans[0][1]
    for a, b in spans[1:]:
        count += a - reach >= gap or (a > reach and any(reach <= g1 and a >= g0 for g0, g1 in bands))
        reach = max(reach, b)
    return count


def page_of(s: dict[str, np.ndarray], width: float, scan: bool) -> tuple[float, int, float, list[float], list[Sequence]]:
    """Values of PAGE_LINES of one page's spans, the lines' as columns: lines in reading order, with the bounds and the usual step of their region.

    A line is bold if 0.6 of its characters are. A region with none beside it reaches to the page's last character."""
    members: list[list[int]] = []
    rows, bands = lines_of(s, members)
    if not rows:
        return 1.0, 1, 0.0, [], []
    columns = dict(zip(LINE_COLUMNS, map(np.array, zip(*rows, strict=True)), strict=True))
    x, y, w, h, base, size = (columns[c].astype(float) for c in LINE_COLUMNS[1:7])
    parts, sure = regions(columns, width, bands)
    em = float(np.median(size)) or 10.0
    sibling = (_overlaps(y, y + h) - 2 * np.eye(len(rows)) > SAME_ROW).any(1)
    every, first = np.array([i for m in members for i in m]), np.cumsum([0, *map(len, members[:-1])])
    chars = np.array([len(t) for t in s["text"]])[every]
    bold = np.add.reduceat(chars * s["bold"][every].astype(bool), first) / np.maximum(1, np.add.reduceat(chars, first)) > BOLD_SHARE
    largest = np.maximum.reduceat(s["font_size"][every].astype(float), first)
    boxes = [(x[p].min(), (x + w)[p].max(), y[p].min(), (y + h)[p].max()) for p in parts]
    columns_ = column_count([(a, b, len(p)) for (a, b, _, _), p in zip(boxes, parts, strict=True)], width, max(em * 1.6, width * 0.035), bands)
    if columns_ > 3:
        sure = min(sure, 0.5)
    end, of = (x + w).max(), []
    for k, (part, (left, right, top, low)) in enumerate(zip(parts, boxes, strict=True)):
        beside = any(j != k and o[0] >= right - 1 and min(o[3], low) > max(o[2], top) for j, o in enumerate(boxes))
        steps = np.diff(base[part])
        steps = np.sort(steps[steps > 0])
        usual = steps[int(np.floor((len(steps) - 1) * 0.3 + 0.5))] if len(steps) else median(size[part].tolist()) * 1.2
        of += [(k, left, right if beside else max(right, end), usual)] * len(part)
    order, (region, left, right, usual) = np.concatenate(parts), np.array(of, float).T
    out = [region.astype(np.int32), [rows[i][0].rstrip() for i in order.tolist()], *(v[order] for v in (x, y, w, h, base, size, largest, bold, sibling)), left, right, usual]
    dominant, texts = 0.0, []
    if scan:
        weight = np.array([len(t.strip()) for t in s["text"]])
        order = np.argsort(s["font_size"], kind="stable")
        order = order[(weight[order] > 0) & (s["font_size"][order] > 0)]
        if len(order):
            dominant = float(s["font_size"][order][np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2)])
        long = [np.floor(r[6] * 2 + 0.5) / 2 for r in rows if len(r[0].strip()) >= LONG_LINE]
        texts = sorted({float(v) for v in long if long.count(v) >= TEXT_LINES})
        sure = min(sure, SCAN_SURE)
    return float(sure), columns_, dominant, texts, out


def page_lines(spans: pa.Array, width: pa.Array, scan: pa.Array) -> pa.Array:
    """Pages' spans, arrays of structs in order of seq, to PAGE_LINES."""
    flat = spans.flatten()
    values = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    ends = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
    pages = [page_of({c: v[a:b] for c, v in values.items()}, float(p), bool(q)) for a, b, p, q in zip(ends, ends[1:], width.to_pylist(), scan.to_pylist(), strict=False)]
    kinds = [pa.int32(), pa.string(), *[pa.float64()] * 7, pa.bool_(), pa.bool_(), *[pa.float64()] * 3]
    held = [p[4] for p in pages if p[4]]
    joined = [[t for c in held for t in c[k]] if k == 1 else np.concatenate([[], *(c[k] for c in held)]).astype(t.to_pandas_dtype()) for k, t in enumerate(kinds)]
    every = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(joined, kinds, strict=True)], names=_LINE)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[4][0]) if p[4] else 0 for p in pages])]).astype(np.int32))
    first = [pa.array([p[k] for p in pages], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64())))]
    return pa.StructArray.from_arrays([*first, pa.ListArray.from_arrays(offsets, every)], names=["confidence", "columns", "dominant", "text_sizes", "lines"])


def body_sizes(spans: DataFrame, doc: str, scan: Column) -> DataFrame:
    """Adds body_size, the document's: the half point with most characters, at most 40 a span, the smaller on ties; native
    pages alone if they have 300 characters; 10.5 without any. Both windows share one sort."""
    weight = F.least(F.lit(SPAN_CHARS), T.utf16_length(T.trimmed(F.col("text"))))
    df = spans.withColumn("_key", round_half_up(F.col("font_size") * 2) / 2).withColumn("_own", F.when(scan, 0).otherwise(weight)).withColumn("_all", weight)
    sorted_ = Window.partitionBy(doc).orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_native", F.sum("_own").over(sorted_) >= NATIVE_SAMPLE)
    df = df.withColumn("_w", F.sum(F.when(F.col("_native"), F.col("_own")).otherwise(F.col("_all"))).over(Window.partitionBy(doc, "_key")))
    most = F.max(F.struct("_w", (-F.col("_key")).alias("k"))).over(Window.partitionBy(doc))
    return df.withColumn("body_size", F.when((most["_w"] > 0) & (most["k"] < 0), -most["k"]).otherwise(USUAL_SIZE)).drop("_key", "_own", "_all", "_native", "_w")


def with_fields(row: Column, names: Sequence[str], **more: Column) -> Column:
    return F.struct(*[row[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def median_of(values: Column) -> Column:
    """Median of an array, null for an empty one."""
    held = F.array_sort(values)
    n = F.size(values)
    return (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2


def begins_block(prev: Column, line: Column, scan: Column) -> Column:
    """Does a line start a block, after prev? Lines have marker, ends, cjk and numbered beside LINE."""
    em = F.least(prev["font_size"], line["font_size"])
    em = F.when(em > 0, em).otherwise(10.0)
    reach = line["right"] - em * F.when(scan, SCAN_SLACK).otherwise(SLACK)
    early, short = prev["x"] + prev["w"] < reach, line["x"] + line["w"] < reach
    marked, indented = prev["marker"].isNotNull(), line["x"] > line["left"] + em * INDENT
    hanging = marked & (line["x"] < prev["x"] - em * INDENT) & (early | short)
    native = (early & ~indented & prev["ends"]) | (early & prev["cjk"]) | (indented & ~early)
    scanned = prev["numbered"] | line["numbered"] | (early & (prev["ends"] | prev["cjk"]))
    far = line["baseline"] - prev["baseline"] > line["base"] * GAP + 1
    other = (prev["region"] != line["region"]) | (F.abs(prev["font_size"] - line["font_size"]) > em * SIZE_STEP) | (prev["bold"] != line["bold"])
    return far | other | line["marker"].isNotNull() | hanging | F.when(scan, scanned).otherwise(native)


def heading_level(b: Column, scan: Column) -> Column:
    """1 to 4 for a block that is a heading, else null. Blocks have joined, n, ratio, depth, cjk_level, bold, sibling, ends."""
    chars, ratio = T.utf16_length(b["joined"]), b["ratio"]
    larger = F.when(scan, SCAN_LARGER).otherwise(LARGER)
    strong = b["bold"] & ~b["sibling"]
    by_size = (ratio >= larger) & ((b["n"] == 1) | (ratio >= MUCH_LARGER)) & ~b["joined"].rlike(r"[，、,]\z")
    by_weight = strong & (ratio >= F.lit(0.98)) & ~b["ends"] & (chars <= 60)
    by_number = b["depth"].isNotNull() & (strong | (ratio >= F.when(scan, SCAN_LARGER).otherwise(1.05)))
    on_scan = scan & ~b["ends"] & ((b["cjk_level"].eqNullSafe(2) & (b["n"] == 1) & (chars <= 30)) | ((b["depth"] >= 2) & (chars <= 40)))
    level = F.when(b["depth"].isNotNull(), F.least(F.lit(4), b["depth"])).when(b["cjk_level"].isNotNull() & (ratio < F.lit(1.4)), b["cjk_level"])
    level = level.when(ratio >= F.lit(1.7), 1).when(ratio >= F.lit(1.4), 2).when(ratio >= F.lit(1.18), 3).otherwise(4)
    heading = by_size | by_weight | by_number | F.coalesce(on_scan, F.lit(False))
    return F.when((b["n"] <= 3) & chars.between(1, 120) & heading, level)


def alignment(lines: Column, left: Column, right: Column) -> Column:
    n = F.size(lines)
    mean = lambda f: F.aggregate(lines, F.lit(0.0), lambda s, x: s + f(x)) / n
    before, after = mean(lambda x: x["x"] - left), mean(lambda x: right - x["x"] - x["w"])
    width = F.greatest(F.lit(1.0), right - left)
    full = (n >= 3) & F.forall(F.slice(lines, F.lit(1), n - 1), lambda x: right - x["x"] - x["w"] < x["font_size"] * F.lit(0.6))
    centered = (before > width * F.lit(0.12)) & (F.abs(before - after) < width * F.lit(0.06))
    return F.when(centered, "center").when((before > width * 0.25) & (after < width * F.lit(0.05)), "right").when(full, "justify").otherwise("left")


def layout(spans: DataFrame, page: Sequence[str] = PAGE, doc: str = "doc_id", width: str = "page_width") -> DataFrame:
    """Blocks of pages: page's columns, reading_order (from 0 on each page), region, kind (paragraph, heading, list-item),
    level, ordered, marker (of items whose numbers a writer can't make by itself: a part of the text), alignment, text,
    lines, x, y, w, h, font_size, bold, first_line_indent, space_after, line_spacing, line_rule, body_size, columns,
    confidence (of the reading order).

    spans: page's columns, seq, text, x, y, w, h, baseline, font_size, page_width; optional bold, rotation, vertical, and
    scan (of the page: recognized or hidden text). Null bold and scan count as false, blank spans are left out, a page
    of nothing else has no block. One shuffle, by doc; none if spans are dealt by doc already."""
    known = set(spans.columns)
    scan = F.coalesce(F.col("scan"), F.lit(False)) if "scan" in known else F.lit(False)
    bold = F.coalesce(F.col("bold"), F.lit(False)) if "bold" in known else F.lit(False)
    turned = [c for c in ("rotation", "vertical") if c in known]
    sized = body_sizes(spans.where(F.col("text").rlike(f"[^{T.SPACE}]")), doc, scan)
    fields = F.struct("seq", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "baseline", "font_size")], bold.alias("bold"), *turned)
    pages = sized.groupBy(*page).agg(F.sort_array(F.collect_list(fields)).alias("_spans"), F.first("body_size").alias("body_size"), F.max(F.col(width).cast("double")).alias("_width"), F.bool_or(scan).alias("_scan"))
    pages = pages.withColumn("_page", F.arrow_udf(page_lines, PAGE_LINES)("_spans", "_width", "_scan")).drop("_spans")
    scan = F.col("_scan")

    def told(x: Column) -> Column:
        text, marker = T.trimmed(x["text"]), T.list_marker(x["text"])
        short = (T.utf16_length(text) <= 40) & ~T.ends_sentence(text) & (x["x"] + x["w"] < x["right"] - x["font_size"] * SCAN_SLACK)
        numbered = scan & short & (F.coalesce(T.section_depth(text) >= 2, F.lit(False)) | F.coalesce(T.list_marker(text)["ordered"], F.lit(False)))
        return with_fields(x, _LINE, marker=marker, ends=T.ends_sentence(x["text"]), cjk=T.contains_cjk(x["text"]), numbered=numbered)

    # no filter on what is made below: it would be pushed down to the page, with all that it is made of
    df = pages.withColumn("_lines", F.transform("_page.lines", told))
    count = F.size("_lines")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    first = lambda i: (i == 0) | begins_block(F.get("_lines", i - 1), F.get("_lines", i), scan)
    df = df.withColumn("_starts", F.filter(every, first))
    df = df.withColumn("_blocks", F.transform("_starts", lambda s, k: F.slice("_lines", s + 1, F.coalesce(F.get("_starts", k + 1), count) - s)))

    def measured(b: Column) -> Column:
        of = lambda name: F.transform(b, lambda x: x[name])
        steps = F.filter(F.transform(b, lambda x, i: F.when(i > 0, x["baseline"] - F.get(b, i - 1)["baseline"])), lambda v: v > 0)
        return F.struct(
            b.alias("ls"), F.size(b).alias("n"), T.trimmed(F.array_join(of("text"), " ")).alias("joined"), T.join_lines(of("text")).alias("text"), median_of(of("font_size")).alias("size"),
            F.array_max(of("largest")).alias("largest"), F.forall(b, lambda x: x["bold"]).alias("bold"), F.exists(b, lambda x: x["sibling"]).alias("sibling"), steps.alias("steps"),
        )

    base = ["ls", "n", "joined", "text", "size", "largest", "bold", "sibling", "steps"]
    df = df.withColumn("_blocks", F.transform("_blocks", measured))
    # recognized sizes differ from page to page: a page's own text is its measure, and so is each size that it has lines of
    body = F.when(scan, F.greatest("body_size", "_page.dominant")).otherwise(F.col("body_size"))
    usual = lambda b: F.exists("_page.text_sizes", lambda t: F.abs(b["size"] / t - 1) < F.lit(NEAR_TEXT))
    ratio = lambda b: b["size"] / F.when(usual(b), F.greatest(body, b["size"])).otherwise(body)
    df = df.withColumn("_blocks", F.transform("_blocks", lambda b: with_fields(b, base, ratio=ratio(b), depth=T.section_depth(b["joined"]), cjk_level=T.cjk_section_level(b["joined"]), ends=T.ends_sentence(b["joined"]))))
    base += ["ratio", "depth", "cjk_level", "ends"]
    df = df.withColumn("_blocks", F.transform("_blocks", lambda b: with_fields(b, base, heading=heading_level(b, scan))))
    base += ["heading"]

    def kind(b: Column) -> Column:
        head = F.get(b["ls"], F.lit(0))
        own = T.cjk_section_level(head["text"]).eqNullSafe(2) | (scan & (F.coalesce(T.section_depth(head["text"]) >= 2, F.lit(False)) | b["bold"]))
        titled = b["heading"].isNotNull() & ((b["ratio"] >= F.when(scan, SCAN_LARGER).otherwise(LARGER)) | own)
        return F.when(head["marker"].isNotNull() & (b["n"] <= 6) & ~titled, "list-item").when(b["heading"].isNotNull(), "heading").otherwise("paragraph")

    df = df.withColumn("_blocks", F.transform("_blocks", lambda b: with_fields(b, base, kind=kind(b))))
    pitch = F.coalesce(median_of(F.flatten(F.transform(F.filter("_blocks", lambda b: b["kind"] != "heading"), lambda b: b["steps"]))), F.lit(0.0))
    # a block's row takes the next one's first baseline with it, not the page's blocks
    base += ["kind"]
    following = lambda b, i: with_fields(b, base, next=F.get(F.get("_blocks", i + 1)["ls"], F.lit(0))["baseline"])
    df = df.withColumn("_pitch", pitch).withColumn("_blocks", F.transform("_blocks", following))
    df = df.select(*page, "body_size", "_page.columns", "_page.confidence", "_pitch", F.posexplode_outer("_blocks").alias("reading_order", "b")).where(F.col("b").isNotNull()).withColumn("_next", F.col("b.next"))
    b = F.col("b")
    head, last, listed = F.get(b["ls"], F.lit(0)), F.element_at(b["ls"], -1), b["kind"] == "list-item"
    edge = lambda f, g: g(F.transform(b["ls"], f))
    left, top = edge(lambda x: x["x"], F.array_min), edge(lambda x: x["y"], F.array_min)
    own_pitch = median_of(b["steps"])
    spacing = D.line_spacing(own_pitch, b["size"], F.greatest(b["largest"], b["size"]), b["n"], F.col("_pitch"))
    level = F.when(listed, F.least(F.lit(4), F.floor(F.greatest(F.lit(0.0), head["x"] - head["left"]) / F.greatest(head["font_size"] * F.lit(1.4), F.lit(8.0))).cast("int"))).otherwise(b["heading"])
    marker = F.when(listed, head["marker"])
    literal = marker["style"] == "other"
    paragraph = b["kind"] == "paragraph"
    text = F.when(listed & ~literal, F.coalesce(T.list_marker(b["text"])["rest"], b["text"])).otherwise(b["text"])
    return df.select(
        *page, "reading_order", head["region"].alias("region"), b["kind"].alias("kind"), level.alias("level"), marker["ordered"].alias("ordered"), F.when(literal, marker["marker"]).alias("marker"),
        F.when(paragraph, alignment(b["ls"], head["left"], head["right"])).alias("alignment"), text.alias("text"), b["n"].alias("lines"), left.alias("x"), top.alias("y"),
        (edge(lambda x: x["x"] + x["w"], F.array_max) - left).alias("w"), (edge(lambda x: x["y"] + x["h"], F.array_max) - top).alias("h"), b["size"].alias("font_size"), b["bold"].alias("bold"),
        F.when(paragraph, D.clamp_indent(head["x"] - head["left"], head["font_size"])).alias("first_line_indent"), D.space_after(F.col("_next") - last["baseline"], own_pitch, F.col("_pitch"), last["font_size"]).alias("space_after"),
        F.when(paragraph, spacing["spacing"]).alias("line_spacing"), F.when(paragraph, spacing["rule"]).alias("line_rule"), "body_size", "columns", "confidence",
    )
