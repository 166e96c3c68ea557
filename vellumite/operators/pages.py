"""Page layout: lines from spans, column gutters, reading order.

Line building compares each span with the running mean of its line, and cutting a page into regions is recursive, so both
work page by page in Python. Pages are small and independent; they are dealt by (doc_id, page_index) and cut from sorted
Arrow batches, many in one, and a page that goes through both steps goes through them in one function, after one shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..functions.text import CJK as _CJK

PAGE = ("doc_id", "page_index")
# Fixed values, in em or shares of the page as named.
TIGHT, LOOSE, SMALLER = 0.35, 0.6, 0.8  # baseline tolerance; for sub- and superscripts; what counts as one
LINE_OVERLAP, SPLIT_EM, SPLIT_PT = 0.3, 2.5, 18.0
WORD_GAP, CJK_GAP = 0.22, 0.9
WIDE_PAGE, WIDE_TEXT, CROSSING, EDGE = 0.6, 0.75, 0.04, 0.15
GUTTER_EM, GUTTER_PT, BESIDE_EM, BESIDE, LONG_LINES, LONG_CHARS, SIDE_BY_SIDE_EM = 0.5, 6.0, 1.2, 4, 3, 15, 2.5
COLUMN_EM, COLUMN_SHARE, ROW_EM, ROW_PT, DEPTH = 1.6, 0.035, 1.35, 6.0, 8

_CJK_CHAR = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), _CJK) + "]")
_APART = re.compile("[\\s\u1100-\U0010ffff]")


def _is_cjk(char: str) -> bool:
    return char >= "\u1100" and _CJK_CHAR.match(char) is not None


def _spaced(texts: Sequence[str], gap: np.ndarray, em: np.ndarray) -> np.ndarray:
    """Has each text but the first a space before it: is the gap wide for the neighbouring scripts?"""
    if not _APART.search("".join(texts)):
        return gap > em * WORD_GAP
    cjk = lambda k: np.array([_is_cjk(t[k]) for t in texts], bool)
    blank = lambda k: np.array([t[k].isspace() for t in texts], bool)
    share = np.where(cjk(-1)[:-1] | cjk(0)[1:], CJK_GAP, WORD_GAP)
    return (gap > em * share) & ~blank(-1)[:-1] & ~blank(0)[1:]


def _groups(arrays: Sequence[np.ndarray]) -> np.ndarray:
    """Number of the line of each span (x, y, w, h, baseline, size, sorted by baseline): a span stays in the last line
    while it is near the mean of its spans. Spans alike in all but x and w are one step: what begins a line takes them along."""
    x, y, w, h, base, size = arrays
    n = len(x)
    alike = (np.diff(base) == 0) & (np.diff(y) == 0) & (np.diff(h) == 0) & (np.diff(size) == 0) & (h[1:] > 0) if n else np.zeros(0, bool)
    bounds = np.concatenate(([0], np.flatnonzero(~alike) + 1, [n]))
    stop = np.repeat(bounds[1:], np.diff(bounds)).tolist()
    # plain lists: the fold below reads single numbers
    y, h, base, scale = y.tolist(), h.tolist(), base.tolist(), np.maximum(size, h).tolist()
    starts: list[int] = []
    total = top = low = tall = 0.0
    i = 0
    while i < n:
        if starts:
            big, small = max(tall, scale[i]), min(tall, scale[i])
            slack = max(1.0, big * (LOOSE if small < big * SMALLER else TIGHT))
            shorter = min(low - top, h[i])
            over = max(0.0, min(low, y[i] + h[i]) - max(top, y[i]))
            if abs(base[i] - total / (i - starts[-1])) <= slack and shorter > 0 and over / shorter > LINE_OVERLAP:
                total, tall, top, low = total + base[i], big, min(top, y[i]), max(low, y[i] + h[i])
                i += 1
                continue
        starts.append(i)
        total, tall, top, low = base[i], scale[i], y[i], y[i] + h[i]
        for _ in range(i + 1, stop[i]):
            total += base[i]
        i = stop[i]
    return np.repeat(np.arange(len(starts)), np.diff([*starts, n])) if n else np.zeros(0, int)


def gutters(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, size: np.ndarray, chars: np.ndarray, page_width: float | None) -> list[tuple[float, float]]:
    """Vertical bands between columns: hardly covered by spans, with text lines along both edges.

    Coverage by points is the running sum of where spans begin and end; bands are its runs at or below what titles and
    stray spans may cover."""
    if len(x) < 2 * BESIDE:
        return []
    left, right, em = x.min(), (x + w).max(), float(np.median(size)) or 10.0
    width = right - left
    if width < 20 * em:
        return []
    n = int(np.ceil(width)) + 2
    steps = np.zeros(n + 1, int)
    np.add.at(steps, np.maximum(0, np.floor(x - left).astype(int)), 1)
    np.add.at(steps, np.minimum(n - 1, np.ceil(x + w - left).astype(int)) + 1, -1)
    wide = int((w > (page_width * WIDE_PAGE if page_width else width * WIDE_TEXT)).sum())
    free = np.cumsum(steps)[:n] <= wide + max(1, int((len(x) - wide) * CROSSING))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(int), [0]))))
    found = []
    for a, b in edges.reshape(-1, 2):
        start, end = left + a, left + b
        if b - a < max(GUTTER_PT, em * GUTTER_EM) or start < left + width * EDGE or end > right - width * EDGE:
            continue
        sides = [(x + w <= start + 0.5) & (x + w >= start - em * BESIDE_EM), (x >= end - 0.5) & (x <= end + em * BESIDE_EM)]
        if min(s.sum() for s in sides) < BESIDE or max((s & (chars >= LONG_CHARS)).sum() for s in sides) < LONG_LINES:
            continue
        top, low = max(y[s].min() for s in sides), min((y + h)[s].max() for s in sides)
        if low - top >= SIDE_BY_SIDE_EM * em:
            found.append((float(start), float(end)))
    return found


def page_lines(spans: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[float, float]]]:
    """Lines of one page (seq, text, x, y, w, h, baseline, font_size, spans) in reading order, and its gutters.

    spans: seq, text, x, y, w, h, baseline, font_size, and where known page_width, rotation, vertical."""
    s = spans.sort_values("seq", kind="stable")
    rows, bands = lines_of({c: s[c].to_numpy() for c in s.columns})
    lines = pd.DataFrame(rows, columns=LINE_COLUMNS)
    lines.insert(0, "seq", np.arange(len(lines)))
    return lines, bands


def lines_of(spans: Mapping[str, np.ndarray], members: list[list[int]] | None = None) -> tuple[list[tuple], list[tuple[float, float]]]:
    """Rows of LINE_COLUMNS of one page's spans (arrays, in order of seq), and the page's gutters.

    members, if given, gets the places of each line's spans, from left to right."""
    kept = np.array([bool(t.strip()) for t in spans["text"]], bool)
    every = [t for t, k in zip(spans["text"], kept, strict=True) if k]
    turned = np.zeros(len(every), bool)
    if "vertical" in spans:
        turned |= np.array([bool(v) and v == v for v in spans["vertical"][kept]], bool)
    if "rotation" in spans:
        turned |= np.array([r is not None and 1 <= r <= 359 for r in spans["rotation"][kept]], bool)
    columns = {c: np.asarray(spans[c][kept], float) for c in ("x", "y", "w", "h", "baseline", "font_size")}
    flat = np.flatnonzero(~turned)
    flat = flat[np.lexsort((columns["x"][flat], columns["baseline"][flat]))]
    arrays = [columns[c][flat] for c in ("x", "y", "w", "h", "baseline", "font_size")]
    texts = [every[i] for i in flat]
    groups = _groups(arrays)
    width = float(spans["page_width"][0]) if "page_width" in spans and len(spans["page_width"]) else None
    bands = gutters(*arrays[:4], arrays[5], np.array([len(t.strip()) for t in texts]), width) if texts else []
    rows, places = [], []
    at = np.flatnonzero(kept)
    if texts:
        order = np.lexsort((arrays[0], groups))
        x, y, w, h, base, size = (a[order] for a in arrays)
        texts, end, scale = [texts[i] for i in order.tolist()], x + w, np.maximum(size, h)
        gap, em, least = x[1:] - end[:-1], np.maximum(scale[:-1], scale[1:]), np.minimum(size[:-1], size[1:])
        cut = (np.diff(groups[order]) != 0) | (gap > np.maximum(SPLIT_EM * np.where(em == 0, 10, em), SPLIT_PT))
        for g0, g1 in bands:
            cut |= (end[:-1] <= g0 + 1) & (x[1:] >= g1 - 1)
        spaced = ~cut & _spaced(texts, gap, np.where(least != 0, least, np.where(size[1:] != 0, size[1:], 10)))
        pieces = [texts[0], *(" " + t if apart else t for t, apart in zip(texts[1:], spaced.tolist(), strict=True))]
        first = np.concatenate(([0], np.flatnonzero(cut) + 1))
        left, high, wide = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first), np.maximum.reduceat(end, first)
        low, smallest = np.maximum.reduceat(y + h, first), np.minimum.reduceat(size, first)
        alike = smallest == np.maximum.reduceat(size, first)
        base, size, place, ends = base.tolist(), size.tolist(), at[flat[order]].tolist(), [*first[1:].tolist(), len(texts)]
        values = zip(first.tolist(), ends, *(v.tolist() for v in (left, high, wide - left, low - high, smallest, alike)), strict=True)
        for a, b, *box, one, same in values:
            places.append(place[a:b])
            rows.append(("".join(pieces[a:b]), *box, sum(base[a:b]) / (b - a), one if same else median(size[a:b]), b - a))
    for i in np.flatnonzero(turned):
        places.append([int(at[i])])
        rows.append((every[i], *(float(columns[c][i]) for c in ("x", "y", "w", "h", "baseline", "font_size")), 1))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][5], rows[k][1]))
    if members is not None:
        members += [places[k] for k in order]
    return [rows[k] for k in order], bands


def _free(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner gaps of a set of intervals."""
    order = np.argsort(start, kind="stable")
    reach = np.maximum.accumulate(end[order])[:-1]
    after = start[order][1:]
    gap = after > reach
    return reach[gap], after[gap]


def regions(lines: Mapping[str, np.ndarray], page_width: float, bands: Sequence[tuple[float, float]] = ()) -> tuple[list[np.ndarray], float]:
    """Positions of the lines of each region, in reading order, and how sure the columns are (0.5 to 1).

    A page is cut at its widest column gap or, without one, at its widest row gap, and so on in the parts, left and upper
    parts first."""
    x, y, w, h, base = (np.asarray(lines[c], float) for c in ("x", "y", "w", "h", "baseline"))
    em = float(np.median(lines["font_size"])) if len(x) else 10.0
    column, row = max((em or 10) * COLUMN_EM, page_width * COLUMN_SHARE), max((em or 10) * ROW_EM, ROW_PT)
    known = lambda a, b: np.array([any(p <= g1 and q >= g0 for g0, g1 in bands) for p, q in zip(a, b, strict=True)], bool)
    out, sure, todo = [], 1.0, [(np.arange(len(x)), 0)] if len(x) else []
    while todo:
        at, depth = todo.pop()
        parts = None
        if len(at) > 1 and depth < DEPTH:
            for start, size, place, least in ((x, w, x + w / 2, column), (y, h, base, row)):
                a, b = _free(start[at], start[at] + size[at])
                ok = (b - a >= least) | (known(a, b) if start is x else False)
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                k = int(np.argmax(b - a))
                first = place[at] < (a[k] + b[k]) / 2
                if first.any() and not first.all():
                    if start is x and not known(a[k : k + 1], b[k : k + 1])[0]:
                        sure = min(sure, min(1.0, max(0.5, (b[k] - a[k]) / (1.8 * column))))
                    parts = (at[first], at[~first])
                    break
        if parts is None:
            out.append(at[np.lexsort((x[at], base[at]))])
        else:
            todo += [(parts[1], depth + 1), (parts[0], depth + 1)]
    return out, sure


LINE_COLUMNS = ["text", "x", "y", "w", "h", "baseline", "font_size", "spans"]
LINE_SCHEMA = "seq int, text string, x double, y double, w double, h double, baseline double, font_size double, spans int"


def wrapped(text: Column, advance: float, width: float) -> Column:
    """Words of a line (array of struct(text, row, x)), filled into rows of a width; each character and space is `advance`
    wide. A word goes on a new row if it doesn't fit behind the last one."""
    from pyspark.sql import functions as F

    def fill(texts: pa.Array) -> pa.Array:
        words, rows, places, ends = [], [], [], [0]
        for t in texts.to_pylist():
            row, x = 0, 0.0
            for word in t.split(" ") if t else ():
                if word:
                    w = len(word) * advance
                    if x and x + w > width:
                        row, x = row + 1, 0.0
                    words.append(word)
                    rows.append(row)
                    places.append(x)
                    x += w + advance
            ends.append(len(words))
        made = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(rows, pa.int32()), pa.array(places, pa.float64())], names=["text", "row", "x"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return F.arrow_udf(fill, "array<struct<text:string,row:int,x:double>>")(text)


def _by_page(spans: DataFrame, page: Sequence[str], make: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """make's rows of each page's spans, beside the page's key.

    A window numbers a page's spans by seq: Spark shuffles for it only what doesn't lie together yet, and sorts. Pages are
    cut from the sorted Arrow batches: many small pages pass in one batch, and a page that goes on in the next batch is
    held until it is whole."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    kinds = dict(spans.dtypes)
    known = [c for c in ("text", "x", "y", "w", "h", "baseline", "font_size", "page_width", "rotation", "vertical") if c in kinds]
    rows = spans.select(*page, "seq", *known).withColumn("_nth", F.row_number().over(Window.partitionBy(*page).orderBy("seq")))
    out = ", ".join(f"{c} {kinds[c]}" for c in page) + ", " + schema
    names = [field.split()[0] for field in schema.split(", ")]
    numbers = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [numbers[field.split()[1]] for field in schema.split(", ")]

    def whole(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy() for c in known}
        made, of = [], []
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            found = make({c: v[a:b] for c, v in columns.items()})
            made += found
            of += [a] * len(found)
        keys = [table.column(c).take(pa.array(of, pa.int64())).combine_chunks() for c in page]
        values = [pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays([*keys, *values], names=[*page, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            # a page begins where its spans are numbered anew
            starts = np.flatnonzero(batch.column("_nth").to_numpy() == 1).tolist()
            now = pa.Table.from_batches([batch])
            if not starts:
                held.append(now)
                continue
            if starts[0]:
                held.append(now.slice(0, starts[0]))
            if held:
                yield whole(pa.concat_tables(held), [0])
            if len(starts) > 1:
                yield whole(now.slice(starts[0], starts[-1] - starts[0]), [k - starts[0] for k in starts[:-1]])
            held = [now.slice(starts[-1])]
        if held:
            yield whole(pa.concat_tables(held), [0])

    return rows.mapInArrow(run, out)


def build_lines(spans: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """page, LINE_SCHEMA."""
    return _by_page(spans, page, lambda s: [(k, *r) for k, r in enumerate(lines_of(s)[0])], LINE_SCHEMA)


def reading_order(spans: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """page, region, position (of the line on its page), LINE_SCHEMA, confidence; needs page_width."""

    def make(s: dict[str, np.ndarray]) -> list[tuple]:
        rows, bands = lines_of(s)
        if not rows:
            return []
        columns = dict(zip(LINE_COLUMNS, zip(*rows, strict=True), strict=True))
        parts, sure = regions(columns, float(s["page_width"][0]), bands)
        at = [(k, int(i)) for k, part in enumerate(parts) for i in part]
        return [(k, position, i, *rows[i], float(sure)) for position, (k, i) in enumerate(at)]

    return _by_page(spans, page, make, "region int, position int, " + LINE_SCHEMA + ", confidence double")


def palettes(rows: DataFrame, by: str, key: str, vector: str, colors: int) -> DataFrame:
    """by, color, members, center: the points of each group cut into boxes by median cut and refined by k-means.

    A group's points are first summed by rounded place in the JVM, so that a group's task holds places, not rows."""
    from pyspark.sql import functions as F

    from .quantize import median_cut, refine

    place = F.transform(F.slice(vector, 1, 4), lambda v: F.round(v, 2).cast("double"))
    summed = rows.select(by, place.alias("place")).groupBy(by, "place").agg(F.count("*").alias("n"))
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", key=lambda s: s.map(tuple)).reset_index(drop=True)
        points, weight = np.stack(pdf["place"].to_numpy()), pdf["n"].to_numpy(float)
        centers, label = refine(points, weight, median_cut(points, weight, colors))
        mass = np.bincount(label, weight, minlength=len(centers)).astype(int)
        return pd.DataFrame({by: pdf[by].iloc[0], "color": np.arange(len(centers), dtype=np.int32), "members": mass, "center": [c.round(6).tolist() for c in centers]})

    return summed.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, color int, members long, center array<double>")
