"""Structure out of order: nested lists, dense table grids, claims with rollback, insertion one after another.

Lists and grids are windows and joins. Claims and insertion are folds, in which each step sees what the ones before it did;
a page's rows are one row's arrays then, folded by an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import overlap_ratio


def nested_lists(items: DataFrame, by: Sequence[str], seq: str, level: str, ordered: str, levels: int = 10) -> DataFrame:
    """Adds parent (seq of the item that holds this item's list; null in the outermost), list (seq of the list's first
    item), depth (1 for the outermost), position (in its list, from 0) and list_ordered (as its first item is).

    An item lies in a list under the nearest earlier item of a smaller level. A level that was left for a smaller one is
    over: the same level opens a new list then. Levels below the first item's count as its own, those from `levels` on
    as the largest; null ones as 0. One window a level finds the nearest earlier items; no fold."""
    before = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    held = F.least(F.coalesce(F.col(level), F.lit(0)).cast("int"), F.lit(levels - 1))
    root = F.first(held).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    df = items.withColumn("_e", F.greatest(held, root))
    df = df.select("*", *[F.max(F.when(F.col("_e") == k, F.col(seq))).over(before).alias(f"_l{k}") for k in range(levels)])
    nearest = lambda upto: F.greatest(*[F.col(f"_l{k}") for k in range(upto)], F.lit(None)) if upto > 1 else F.col("_l0")
    parent, depth = F.lit(None), F.lit(1)
    for k in range(levels):
        if k:
            parent = F.when(F.col("_e") == k, nearest(k)).otherwise(parent)
        # level k holds an ancestor if no smaller level came after its last item
        open_ = F.col(f"_l{k}").isNotNull() & (F.col("_e") > k)
        depth = depth + (open_ & F.coalesce(F.col(f"_l{k}") > nearest(k), F.lit(True)) if k else open_).cast("int")
    df = df.withColumn("parent", parent.cast(dict(items.dtypes)[seq])).withColumn("depth", depth)
    inside = Window.partitionBy(*by, "parent", "_e").orderBy(seq)
    df = df.withColumn("list", F.first(seq).over(inside)).withColumn("position", F.row_number().over(inside) - 1).withColumn("list_ordered", F.first(ordered).over(inside))
    return df.drop("_e", *[f"_l{k}" for k in range(levels)])


def dense_grid(cells: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """cells (by, row, col, row_span, col_span, and whatever else) -> the cells a writer lists, row by row.

    A table is as large as its cells reach. Places that another cell spans are left out, and so is a cell that begins in
    such a place; of several that begin in one place the last by `order` stays, of equally late ones the first by `ties`;
    a place that none covers gets an empty cell of one by one. Spans under 1 count as 1; cells without a place are left out."""
    spans = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    for c in ("row_span", "col_span"):
        spans = spans.withColumn(c, F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("int"))
    last = F.row_number().over(Window.partitionBy(*by, "row", "col").orderBy(F.col(order).desc(), *ties))
    size = spans.groupBy(*by).agg(F.max(F.col("row") + F.col("row_span")).cast("int").alias("_rows"), F.max(F.col("col") + F.col("col_span")).cast("int").alias("_cols"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    places = size.select(*by, "_cols", F.explode(upto(F.col("_rows"))).alias("_r")).select(*by, "_r", F.explode(upto(F.col("_cols"))).alias("_c"))
    wide = spans.where((F.col("row_span") > 1) | (F.col("col_span") > 1))
    covered = wide.select(*by, "row", "col", "col_span", F.explode(upto(F.col("row_span"))).alias("_dr")).select(*by, "row", "col", "_dr", F.explode(upto(F.col("col_span"))).alias("_dc"))
    covered = covered.where("_dr > 0 OR _dc > 0").select(*by, (F.col("row") + F.col("_dr")).cast("int").alias("_r"), (F.col("col") + F.col("_dc")).cast("int").alias("_c")).distinct()
    kept = spans.withColumn("_k", last).where("_k = 1").withColumnsRenamed({"row": "_r", "col": "_c"}).drop("_k")
    free = places.join(covered, [*by, "_r", "_c"], "left_anti")
    full = free.join(kept.withColumn("_r", F.col("_r").cast("int")).withColumn("_c", F.col("_c").cast("int")), [*by, "_r", "_c"], "left")
    one = {c: F.coalesce(F.col(c), F.lit(1)) for c in ("row_span", "col_span")}
    return full.withColumns(one).withColumnsRenamed({"_r": "row", "_c": "col"})


def flattened(cells: DataFrame, by: Sequence[str], text: str, order: Sequence[str] = ("row", "col")) -> DataFrame:
    """by, text: a table as one paragraph, its cells' texts in order, joined as lines are; tables without text are left out."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t")))), lambda s: s["_t"])
    return cells.groupBy(*by).agg(T.join_lines(lines).alias("text")).where("text <> ''")


def cell_paragraphs(lines: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds `paragraph`, from 1, to lines (baseline, font_size) of a cell: a new one where the step is over 1.6 times the
    cell's usual step and a point. The usual step is the median of those above 0, 1.2 times the first line's size if none."""
    w = Window.partitionBy(*by).orderBy(seq)
    df = lines.withColumn("_gap", F.col("baseline") - F.lag("baseline").over(w))
    usual = F.coalesce(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).over(Window.partitionBy(*by)), F.first("font_size").over(w) * F.lit(1.2))
    begin = F.coalesce(F.col("_gap") > usual * F.lit(1.6) + 1, F.lit(True)).cast("int")
    return df.withColumn("_begin", begin).withColumn("paragraph", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_begin")


def claims(pairs: DataFrame, by: Sequence[str], candidate: str, member: str, least: int = 1) -> DataFrame:
    """pairs (by, candidate, member) -> by, candidate, accepted, members (sorted): candidates claim in order.

    A candidate gets the members that none accepted before it holds. With fewer than `least` of them it is rejected, and
    they are free for the next. Pairs with a null are left out, repeated ones count once. A group is folded as one row's
    array: groups are pages, or what else has a bounded number of candidates."""
    known = pairs.where(F.col(candidate).isNotNull() & F.col(member).isNotNull())
    each = known.groupBy(*by, candidate).agg(F.sort_array(F.collect_set(member)).alias("_all"))
    rows = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(candidate).alias("c"), F.col("_all").alias("m")))).alias("_each"))
    kinds = dict(pairs.dtypes)
    made = f"array<struct<c:{kinds[candidate]},accepted:boolean,m:array<{kinds[member]}>>>"

    def step(state: Column, x: Column) -> Column:
        mine = F.array_except(x["m"], state["taken"])
        good = F.size(mine) >= least
        taken = F.when(good, F.concat(state["taken"], mine)).otherwise(state["taken"])
        out = F.struct(x["c"].alias("c"), good.alias("accepted"), F.when(good, mine).otherwise(F.slice(mine, F.lit(1), F.lit(0))).alias("m"))
        return F.struct(taken.alias("taken"), F.concat(state["out"], F.array(out)).cast(made).alias("out"))

    start = F.struct(F.array().cast(f"array<{kinds[member]}>").alias("taken"), F.array().cast(made).alias("out"))
    folded = rows.select(*by, F.explode(F.aggregate("_each", start, step, lambda s: s["out"])).alias("_o"))
    return folded.select(*by, F.col("_o.c").alias(candidate), F.col("_o.accepted").alias("accepted"), F.col("_o.m").alias("members"))


def unclaimed(lines: DataFrame, claimed: DataFrame, by: Sequence[str], line: str, member: str) -> DataFrame:
    """by, line: lines (by, line, member) of which at least one member is in no accepted claim."""
    held = claimed.where("accepted").select(*by, F.explode("members").alias(member))
    return lines.join(held, [*by, member], "left_anti").select(*by, line).distinct()


BOX = "struct<id:long,item:boolean,x:double,y:double,w:double>"


def insert_by_position(blocks: DataFrame, items: DataFrame, by: Sequence[str], key: str, order: str) -> DataFrame:
    """by, position (from 0), key, item: a page's blocks in their order with its items put in, one after another.

    An item goes before the first block, or item put in earlier, that begins no higher and overlaps it across by over a
    tenth of the narrower; behind all if there is none. Both have by, key, order, x, y, w. Pages of items alone have them in
    order."""
    row = lambda df, item: df.select(*by, F.col(order).alias("_o"), F.struct(F.col(key).cast("long").alias("id"), F.lit(item).alias("item"), *[F.col(c).cast("double").alias(c) for c in "xyw"]).alias("_b"))
    listed = lambda item: F.transform(F.sort_array(F.collect_list(F.when(F.col("_b.item") == item, F.struct("_o", "_b")))), lambda s: s["_b"])
    pages = row(blocks, False).unionByName(row(items, True)).groupBy(*by).agg(listed(False).alias("_blocks"), listed(True).alias("_items"))

    def put(state: Column, x: Column) -> Column:
        lower = F.transform(state, lambda b: (b["y"] >= x["y"]) & (overlap_ratio(b["x"], b["x"] + b["w"], x["x"], x["x"] + x["w"]) > F.lit(0.1)))
        at = F.array_position(lower, True).cast("int")
        before = F.when(at > 0, at - 1).otherwise(F.size(state))
        return F.concat(F.slice(state, F.lit(1), before), F.array(x), F.slice(state, before + 1, F.size(state) - before)).cast(f"array<{BOX}>")

    done = pages.select(*by, F.posexplode(F.aggregate("_items", F.col("_blocks").cast(f"array<{BOX}>"), put)).alias("position", "_b"))
    return done.select(*by, "position", F.col("_b.id").alias(key), F.col("_b.item").alias("item"))
