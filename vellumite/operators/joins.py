"""Joins on geometry. Each has the page as equi-key and a range condition beside it, so that Spark hashes or sorts by
page and never compares across pages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

LISTED = 256


def _sides(left: DataFrame, right: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Column, dict[str, Column], dict[str, Column]]:
    renamed = right.select([F.col(c).alias(f"_r_{c}") for c in right.columns])
    equal = [F.col(c) == F.col(f"_r_{c}") for c in by]
    condition = equal[0]
    for e in equal[1:]:
        condition = condition & e
    return renamed, condition, G.columns(), G.columns("_r_")


def outside(boxes: DataFrame, covers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Boxes whose center lies in none of the covers of their page."""
    right, equal, a, b = _sides(boxes, covers, by)
    return boxes.join(right, equal & G.center_inside(a, b), "left_anti")


def inside(boxes: DataFrame, covers: DataFrame, by: Sequence[str], outset: float = 0.0) -> DataFrame:
    """Pairs of a box and a cover (its columns prefixed `_r_`) that holds the box's center; a box on a border has two."""
    right, equal, a, b = _sides(boxes, covers, by)
    return boxes.join(right, equal & G.center_inside(a, b, outset))


def overlapping(boxes: DataFrame, by: Sequence[str], key: str, cell: tuple[float, float] = (64.0, 32.0), itself: bool = False) -> DataFrame:
    """Pairs of boxes of a page with area in common, each once: the box of the smaller key, the other's columns prefixed
    `_r_`; with itself also boxes of equal key, as each box is with itself. A box lies in every grid cell that it touches,
    and a pair counts in the cell of its common part's first corner."""

    def cells(start: str, length: str, size: float) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(length)) / size)))

    put = boxes.withColumn("_cx", cells("x", "w", cell[0])).withColumn("_cy", cells("y", "h", cell[1]))
    right, equal, a, b = _sides(put, put, [*by, "_cx", "_cy"])
    corner = [F.floor(F.greatest(a[c], b[c]) / size) == F.col(f"_c{c}") for c, size in zip("xy", cell, strict=True)]
    first = F.col(key) <= F.col(f"_r_{key}") if itself else F.col(key) < F.col(f"_r_{key}")
    pairs = put.join(right, equal & first & corner[0] & corner[1] & (G.intersection(a, b) > 0))
    return pairs.drop("_cx", "_cy", "_r__cx", "_r__cy")


def overlapping_keys(boxes: DataFrame, by: Sequence[str], key: str, **measures: Column) -> DataFrame:
    """by, a, b and measures: the keys, a < b, of each two boxes of a page with area in common. Measures are expressions
    over both boxes (the second's columns prefixed `_r_`) that don't depend on which is the first.

    Boxes of equal place and size are compared and measured as one. What is left for each pair is to take one key of either
    list; lists are cut at LISTED keys, so that no row holds more of them. Pairs of lists are few and small beside what they
    become: they are dealt to all partitions, where adaptive execution would put them into one."""
    place = F.struct("x", "y", "w", "h").alias("_at")
    nth = F.row_number().over(Window.partitionBy(*by, "_at").orderBy(key)) - 1
    lists = boxes.select(*by, key, place).withColumn("_part", F.floor(nth / LISTED)).groupBy(*by, "_at", "_part").agg(F.collect_list(key).alias("_keys"))
    places = boxes.select(*by, "x", "y", "w", "h").distinct().withColumn("_at", place)
    pairs = overlapping(places, by, "_at", itself=True).select(*by, "_at", "_r__at", *[c.alias(n) for n, c in measures.items()])
    both = pairs.join(lists.select(*by, "_at", F.col("_part").alias("_p"), F.col("_keys").alias("_a")), [*by, "_at"])
    both = both.join(lists.select(*by, F.col("_at").alias("_r__at"), F.col("_part").alias("_q"), F.col("_keys").alias("_b")), [*by, "_r__at"])
    both = both.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_at", "_r__at", "_p", "_q")
    rows = both.select(*by, (F.col("_at") == F.col("_r__at")).alias("_same"), *measures, "_b", F.explode("_a").alias("_k")).select(*by, "_same", *measures, "_k", F.explode("_b").alias("_m"))
    rows = rows.where((F.col("_k") < F.col("_m")) | (~F.col("_same") & (F.col("_k") > F.col("_m"))))
    return rows.select(*by, F.least("_k", "_m").alias("a"), F.greatest("_k", "_m").alias("b"), *measures)


def ruled(spans: DataFrame, rules: DataFrame, by: Sequence[str], position: str, start: str, end: str, near: float = 2.5, slack: float = 3.0) -> DataFrame:
    """Spans (with columns position, start, end) that have a rule within `near` which covers them, with slack."""
    right = rules.select([F.col(c).alias(f"_r_{c}") for c in rules.columns])
    condition = (F.abs(F.col(f"_r_{position}") - F.col(position)) <= near) & (F.col(f"_r_{start}") <= F.col(start) + slack) & (F.col(f"_r_{end}") >= F.col(end) - slack)
    for c in by:
        condition = (F.col(c) == F.col(f"_r_{c}")) & condition
    return spans.join(right, condition, "left_semi")


def first_after(items: DataFrame, blocks: DataFrame, by: Sequence[str], item: str, at: str, order: str) -> DataFrame:
    """by, item, before: for each item the first block, in order, that lies at or below it; null if none does.

    An as-of join: one union and one window, linear in both sides."""
    left = items.select(*by, F.col(at).alias("_at"), F.col(item).alias("_item"), F.lit(None).cast("long").alias("_order"), F.lit(0).alias("_side"))
    right = blocks.select(*by, F.col(at).alias("_at"), F.lit(None).cast("long").alias("_item"), F.col(order).cast("long").alias("_order"), F.lit(1).alias("_side"))
    later = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("before", F.min("_order").over(later))
    return both.where("_side = 0").select(*by, F.col("_item").alias(item), "before")


def page_components(boxes: DataFrame, by: Sequence[str], key: str, gap: float) -> DataFrame:
    """by, key, component: boxes within gap of each other, transitively; a component is named by its smallest key.

    Pages are small, and each is solved by itself: sorted by x, a box is compared with those that begin before it ends."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", key], kind="stable").reset_index(drop=True)
        x, y, w, h, ids = (pdf[c].to_numpy() for c in ("x", "y", "w", "h", key))
        root = np.arange(len(pdf))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(pdf)):
            last = np.searchsorted(x, x[i] + w[i] + gap, "right")
            j = np.arange(i + 1, last)
            for k in j[(y[j] <= y[i] + h[i] + gap) & (y[i] <= y[j] + h[j] + gap)]:
                a, b = find(i), find(int(k))
                if a != b:
                    root[max(a, b)] = min(a, b)
        roots = np.array([find(i) for i in range(len(pdf))])
        least = pd.Series(ids).groupby(roots).transform("min")
        return pdf[[*by, key]].assign(component=least.to_numpy())

    kinds = dict(boxes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, key)) + f", component {kinds[key]}"
    return boxes.select(*by, key, "x", "y", "w", "h").groupBy(*by).applyInPandas(solve, schema)


def suppress(boxes: DataFrame, by: Sequence[str], key: str, order: str, limit: float = 0.5) -> DataFrame:
    """Greedy suppression: in order, a box stays unless it overlaps one that stayed by more than limit (IoU)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        box, kept = pdf[["x", "y", "w", "h"]].to_numpy(), []
        for i in range(len(pdf)):
            if kept:
                k = box[kept]
                dx = np.minimum(k[:, 0] + k[:, 2], box[i, 0] + box[i, 2]) - np.maximum(k[:, 0], box[i, 0])
                dy = np.minimum(k[:, 1] + k[:, 3], box[i, 1] + box[i, 3]) - np.maximum(k[:, 1], box[i, 1])
                common = np.clip(dx, 0, None) * np.clip(dy, 0, None)
                union = k[:, 2] * k[:, 3] + box[i, 2] * box[i, 3] - common
                if (np.divide(common, union, out=np.zeros_like(common), where=union > 0) > limit).any():
                    continue
            kept.append(i)
        return pdf.iloc[kept]

    return boxes.groupBy(*by).applyInPandas(solve, boxes.schema)


def named_file(references: DataFrame, files: DataFrame, by: Sequence[str], name: str, path: str) -> DataFrame:
    """references (by, name, and whatever else) with path: of the file of that name, or else of one whose name in lower
    case is the reference's in lower case; the smallest path where several would do; null without any.

    Two joins by equal keys, each with one row a key on the right, so that references never multiply."""
    known = files.where(F.col(name).isNotNull())
    best = lambda key, into: known.groupBy(*[F.col(c).alias(f"_{c}") for c in by], key.alias("_key")).agg(F.min(path).alias(into))
    rows = references
    for key, into in ((F.col(name), "_exact"), (F.lower(name), "_folded")):
        side = best(key, into)
        same = key == F.col("_key")
        for c in by:
            same = same & (F.col(c) == F.col(f"_{c}"))
        rows = rows.join(side, same, "left").drop("_key", *[f"_{c}" for c in by])
    return rows.withColumn(path, F.coalesce("_exact", "_folded")).drop("_exact", "_folded")


def image_blocks(images: DataFrame, tables: DataFrame, by: Sequence[str], least: float = 12.0) -> DataFrame:
    """Images (by, x, y, w, h, stored, scan, page_width, page_height) that become blocks: those stored, `least` points wide
    and high at least, but not a scan's picture of the whole page, whose text was read, and not on other pages those that
    lie in one of the tables (by, x, y, w, h), within two points. Null flags count as false."""
    scan = F.coalesce(F.col("scan"), F.lit(False))
    whole = scan & G.full_page(G.columns(), F.col("page_width"), F.col("page_height"))
    kept = images.where(F.coalesce(F.col("stored"), F.lit(False)) & (F.col("w") >= least) & (F.col("h") >= least) & ~whole)
    right, equal, a, b = _sides(kept, tables, by)
    return kept.join(right, equal & ~scan & G.contains(b, a, 2.0), "left_anti")


def scaled_scans(pages: DataFrame, parts: DataFrame, by: Sequence[str], lengths: Sequence[str], scale: Column) -> tuple[DataFrame, DataFrame]:
    """(pages, parts) with what lies on a scanned page scaled as the page is: pages (by, width, height, ...) get `scale`,
    which is an expression over them, and the parts' lengths are multiplied by their page's. Parts without a page stay."""
    sized = pages.withColumn("scale", scale)
    named = sized.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("scale").alias("_scale"))
    same = None
    for c in by:
        same = (F.col(c) == F.col(f"_{c}")) if same is None else same & (F.col(c) == F.col(f"_{c}"))
    placed = parts.join(named, same, "left").withColumns({c: F.col(c) * F.coalesce("_scale", F.lit(1.0)) for c in lengths})
    return sized.withColumns({c: F.col(c) * F.col("scale") for c in ("width", "height")}), placed.drop("_scale", *[f"_{c}" for c in by])
