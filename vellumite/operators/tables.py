"""Ruled tables of a page: rules to grids, grids to cells, text to cells.

Rules of one direction are clustered by position and merged along it; crossing rules connect, and each connected set with
two rules a way is a grid. A cell spans columns, then rows, while the rule between is missing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .pages import PAGE

NEAR, SLACK, MIN_W, MIN_H, MOST_CELLS, FILLED, SPARSE_CELLS = 2.5, 3.0, 20.0, 12.0, 4000, 0.35, 6


def _merged(rules: pd.DataFrame) -> pd.DataFrame:
    """Rules of one direction (position, start, end, raster), clustered within NEAR and joined along within SLACK.

    A merged rule is raster if all rules of its cluster are."""
    r = rules.sort_values("position", kind="stable")
    cluster = (r["position"].diff() > NEAR).cumsum()
    position, raster = r["position"].groupby(cluster).transform("mean"), r["raster"].groupby(cluster).transform("all")
    r = r.assign(position=position, raster=raster, _c=cluster).sort_values(["_c", "start", "end"], kind="stable")
    reach = r.groupby("_c")["end"].cummax().groupby(r["_c"]).shift()
    part = (~(r["start"] <= reach + SLACK)).cumsum()
    return r.groupby(part).agg(position=("position", "first"), start=("start", "min"), end=("end", "max"), raster=("raster", "first")).reset_index(drop=True)


def _clusters(values: np.ndarray) -> np.ndarray:
    v = np.sort(values)
    group = np.cumsum(np.concatenate(([0], (np.diff(v) > NEAR).astype(int))))
    return np.bincount(group, v) / np.bincount(group)


def grids(h: pd.DataFrame, v: pd.DataFrame) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """Connected sets of crossing rules, upper ones first."""
    cross = (v["position"].to_numpy()[None] >= h["start"].to_numpy()[:, None] - SLACK) & (v["position"].to_numpy()[None] <= h["end"].to_numpy()[:, None] + SLACK)
    cross &= (h["position"].to_numpy()[:, None] >= v["start"].to_numpy()[None] - SLACK) & (h["position"].to_numpy()[:, None] <= v["end"].to_numpy()[None] + SLACK)
    out, seen = [], np.zeros(len(h), bool)
    for i in range(len(h)):
        if seen[i] or not cross[i].any():
            continue
        rows = np.zeros(len(h), bool)
        rows[i] = True
        while True:
            columns = cross[rows].any(0)
            more = rows | cross[:, columns].any(1)
            if (more == rows).all():
                break
            rows = more
        seen |= rows
        if rows.sum() >= 2 and columns.sum() >= 2:
            out.append((h[rows], v[columns]))
    return sorted(out, key=lambda g: g[0]["position"].min())


def page_tables(rules: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """table_id, row, col, row_span, col_span, x, y, w, h, text, confidence of the cells of one page."""
    kinds = [rules[rules["orientation"] == o] for o in ("horizontal", "vertical")]
    out: list[tuple] = []
    if min(map(len, kinds)) < 2:
        return pd.DataFrame(out, columns=CELLS)
    cx, cy = (spans["x"] + spans["w"] / 2).to_numpy(), (spans["y"] + spans["h"] / 2).to_numpy()
    number = 0
    for hs, vs in grids(*map(_merged, kinds)):
        ys, xs = _clusters(hs["position"].to_numpy()), _clusters(vs["position"].to_numpy())
        rows, cols = len(ys) - 1, len(xs) - 1
        if not 2 <= rows * cols <= MOST_CELLS or xs[-1] - xs[0] < MIN_W or ys[-1] - ys[0] < MIN_H:
            continue

        def ruled(rules_: pd.DataFrame, at: float, a: float, b: float) -> bool:
            return bool(((np.abs(rules_["position"] - at) <= NEAR) & (rules_["start"] <= a + SLACK) & (rules_["end"] >= b - SLACK)).any())

        taken, cells, edges = np.zeros((rows, cols), bool), [], 0
        for r in range(rows):
            for c in range(cols):
                if taken[r, c]:
                    continue
                wide = 1
                while c + wide < cols and not taken[r, c + wide] and not ruled(vs, xs[c + wide], ys[r], ys[r + 1]):
                    wide += 1
                tall = 1
                while r + tall < rows and not taken[r + tall, c : c + wide].any() and not ruled(hs, ys[r + tall], xs[c], xs[c + wide]):
                    tall += 1
                taken[r : r + tall, c : c + wide] = True
                x0, x1, y0, y1 = xs[c], xs[c + wide], ys[r], ys[r + tall]
                edges += ruled(hs, y0, x0, x1) + ruled(hs, y1, x0, x1) + ruled(vs, x0, y0, y1) + ruled(vs, x1, y0, y1)
                inside = (cx >= x0 - 1) & (cx <= x1 + 1) & (cy >= y0 - 1) & (cy <= y1 + 1)
                words = spans[inside].sort_values(["baseline", "x"], kind="stable")["text"]
                cells.append((r, c, tall, wide, x0, y0, x1 - x0, y1 - y0, " ".join(words)))
        full = sum(bool(c[-1].strip()) for c in cells)
        raster = bool(hs["raster"].all() and vs["raster"].all())
        if not full or (raster and len(cells) >= SPARSE_CELLS and full < FILLED * len(cells)):
            continue
        out += [(number, *c, edges / (4 * len(cells))) for c in cells]
        number += 1
    return pd.DataFrame(out, columns=CELLS)


CELLS = ["table_id", "row", "col", "row_span", "col_span", "x", "y", "w", "h", "text", "confidence"]


def ruled_tables(rules: DataFrame, spans: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """page and CELLS. Rules and spans of a page meet by one cogroup."""
    kinds = dict(spans.dtypes)

    def run(key, r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        cells = page_tables(r, s)
        for k, c in enumerate(page):
            cells.insert(k, c, key[k])
        return cells

    schema = ", ".join(f"{c} {kinds[c]}" for c in page) + ", table_id int, row int, col int, row_span int, col_span int, x double, y double, w double, h double, text string, confidence double"
    return rules.groupBy(*page).cogroup(spans.groupBy(*page)).applyInPandas(run, schema)


# --- tables with rules between rows only ------------------------------------------------------------------------------

LEAST_RULE, SAME_WIDTH, SHARED, FAR, TOO_FAR, HEAD = 60.0, 0.6, 0.8, 120.0, 520.0, 26.0
MANY_CELLS, CELL_GAP_EM, CELL_GAP_PT, ALIGNED, COLUMN_OVERLAP, MOST_COLUMNS, CONFLICTS = 0.6, 1.3, 7.0, 4.0, 0.4, 30, 0.1


def rule_stacks(rules: pd.DataFrame) -> list[dict]:
    """Horizontal rules that lie one below the other, like wide and not too far apart: positions, x0, x1, far."""
    out: list[dict] = []
    for r in _merged(rules).sort_values("position", kind="stable").itertuples():
        if r.end - r.start < LEAST_RULE:
            continue
        for s in reversed(out):
            gap, short, long = r.position - s["positions"][-1], *sorted((r.end - r.start, s["x1"] - s["x0"]))
            if gap <= TOO_FAR and short >= SAME_WIDTH * long and min(r.end, s["x1"]) - max(r.start, s["x0"]) >= SHARED * short:
                s["positions"].append(r.position)
                s["x0"], s["x1"], s["far"] = min(s["x0"], r.start), max(s["x1"], r.end), s["far"] or gap > FAR
                break
        else:
            out.append({"positions": [r.position], "x0": r.start, "x1": r.end, "far": False})
    return [s for s in out if len(s["positions"]) >= 2]


def _row_cells(lines: pd.DataFrame) -> list[list[tuple]]:
    """Lines of a band -> rows of cells (x0, x1, y0, y1, texts): one row a baseline where most baselines have several
    cells, else one row of cells joined downwards."""
    em = float(lines["font_size"].median()) or 9.0
    lines = lines.sort_values(["baseline", "x"], kind="stable")
    row = (lines["baseline"].diff() > em * 0.5).cumsum()
    rows = [[(r.x, r.x + r.w, r.y, r.y + r.h, [r.text]) for r in part.itertuples()] for _, part in lines.groupby(row)]
    if len(rows) > 1 and sum(len(r) >= 2 for r in rows) >= MANY_CELLS * len(rows):
        return [_stacked(r) for r in rows]
    return [_stacked([c for r in rows for c in r])]


def _stacked(cells: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for x0, x1, y0, y1, texts in cells:
        home = next((c for c in out if min(x1, c[1]) - max(x0, c[0]) > 0.3 * min(x1 - x0, c[1] - c[0])), None)
        if home is None:
            out.append([x0, x1, y0, y1, list(texts)])
        else:
            home[:4] = min(home[0], x0), max(home[1], x1), min(home[2], y0), max(home[3], y1)
            home[4] += texts
    return sorted((tuple(c) for c in out), key=lambda c: c[0])


def row_tables(rules: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """CELLS of one page's tables that have rules between rows only: their columns are told by how cells line up."""
    cx, cy = spans["x"] + spans["w"] / 2, spans["y"] + spans["h"] / 2
    out: list[tuple] = []
    number = 0
    flat = rules[rules["orientation"] == "horizontal"]
    for s in rule_stacks(flat) if len(flat) else []:
        ys, wide = s["positions"], s["x1"] - s["x0"]
        within = (cx >= s["x0"] - 2) & (cx <= s["x1"] + 2)
        bands = [(ys[0] - HEAD, ys[0]), *zip(ys, ys[1:], strict=False)]
        rows: list[list[tuple]] = []
        for k, (a, b) in enumerate(bands):
            inside = spans[within & (cy > a if k else cy >= a) & (cy < b)]
            if len(inside):
                rows += _row_cells(_cut_lines(inside))
        several = sum(len(r) >= 2 for r in rows)
        if len(rows) < 2 or several < MANY_CELLS * len(rows) or ys[-1] - ys[0] < 10 or wide < 40:
            continue
        columns: list[list[float]] = []
        home: list[list[int]] = []
        for r in rows:
            home.append([])
            for x0, x1, *_ in r:
                j = next((i for i, c in enumerate(columns) if abs(c[0] - x0) <= ALIGNED or abs(c[1] - x1) <= ALIGNED or min(c[1], x1) - max(c[0], x0) > COLUMN_OVERLAP * min(c[1] - c[0], x1 - x0)), None)
                if j is None:
                    columns.append([x0, x1])
                    j = len(columns) - 1
                else:
                    columns[j] = [min(columns[j][0], x0), max(columns[j][1], x1)]
                home[-1].append(j)
        widths = [c[1] - c[0] for r in rows for c in r]
        doubtful = s["far"] and len(ys) < 3 and not (len(columns) >= 3 and len(rows) >= 3 and several == len(rows) and float(np.median(widths)) <= 0.3 * wide)
        clashes = sum(len(h) - len(set(h)) for h in home)
        if not 2 <= len(columns) <= MOST_COLUMNS or doubtful or clashes > CONFLICTS * len(rows):
            continue
        order = sorted(range(len(columns)), key=lambda j: sum(columns[j]))
        edge = [s["x0"], *((columns[a][1] + columns[b][0]) / 2 for a, b in zip(order, order[1:], strict=False)), s["x1"]]
        sure = min(0.9, 0.5 + 0.4 * sum(len(r) == len(columns) for r in rows) / len(rows))
        for i, (r, at) in enumerate(zip(rows, home, strict=True)):
            seen: set[int] = set()
            for (_, _, y0, y1, texts), j in zip(r, at, strict=True):
                c = order.index(j)
                if c not in seen:
                    seen.add(c)
                    out.append((number, i, c, 1, 1, edge[c], y0, edge[c + 1] - edge[c], y1 - y0, " ".join(texts), sure))
        number += 1
    return pd.DataFrame(out, columns=CELLS)


def _cut_lines(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans as pieces of lines, cut where cells begin."""
    s = spans.sort_values(["baseline", "x"], kind="stable")
    step, room = s["baseline"].diff(), s["x"] - (s["x"] + s["w"]).shift()
    em = s["font_size"]
    piece = ((step > 0.35 * em) | (room > np.maximum(CELL_GAP_PT, CELL_GAP_EM * em)) | (room < -em)).cumsum()
    joined = s.assign(right=s["x"] + s["w"], low=s["y"] + s["h"]).groupby(piece).agg(text=("text", " ".join), x=("x", "min"), y=("y", "min"), right=("right", "max"), low=("low", "max"), baseline=("baseline", "mean"), font_size=("font_size", "median"))
    return joined.assign(w=joined["right"] - joined["x"], h=joined["low"] - joined["y"]).reset_index(drop=True)


def row_ruled_tables(rules: DataFrame, spans: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """page and CELLS, by row_tables."""
    kinds = dict(spans.dtypes)

    def run(key, r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        cells = row_tables(r, s)
        for k, c in enumerate(page):
            cells.insert(k, c, key[k])
        return cells

    schema = ", ".join(f"{c} {kinds[c]}" for c in page) + ", table_id int, row int, col int, row_span int, col_span int, x double, y double, w double, h double, text string, confidence double"
    return rules.groupBy(*page).cogroup(spans.groupBy(*page)).applyInPandas(run, schema)
