"""Pages out of a flow, files by name, running budgets."""

from pyspark.sql import functions as F

from vellumite.functions import images as I
from vellumite.operators import aggregates as A
from vellumite.operators import boilerplate as R
from vellumite.operators import joins as J
from vellumite.operators import paging as Y


def sections(spark, *rows):
    """rows: (key, head, foot, page height)."""
    df = spark.createDataFrame([(k, float(a), float(b), float(h)) for k, a, b, h in rows], "d long, head double, foot_height double, height double")
    lit = lambda v: F.lit(float(v))
    box = Y.content_box(lit(300), F.col("height"), {"left": lit(50), "right": lit(50), "top": lit(60), "bottom": lit(60)}, F.col("head"), F.col("foot_height"), lit(20), lit(20))
    return df.select("*", lit(20).alias("head_at"), lit(20).alias("foot_at"), box.alias("body"))


def test_heads_push_the_body_and_leave_it_some_height(spark):
    got = {r.d: r.body for r in sections(spark, (1, 0, 0, 400), (2, 10, 10, 400), (3, 90, 50, 400), (4, 200, 100, 300)).collect()}
    assert tuple(got[1]) == (50, 60, 200, 280) and tuple(got[2]) == tuple(got[1])
    assert tuple(got[3]) == (50, 116, 200, 400 - 116 - 76) and tuple(got[4]) == (50, 226, 200, 72)


def test_ops_of_columns_lie_on_pages_with_bands_on_each(spark):
    s = sections(spark, (1, 0, 0, 400), (2, 10, 10, 400), (3, 10, 0, 400))
    ops = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 247.5, 5.0), (1, 2, 246.9, 0.0), (2, 0, -3.0, 0.0), (2, 1, 500.0, 7.0)], "d long, seq int, x double, y double")
    bands = spark.createDataFrame([(2, "head", 0, 1.0, 2.0), (2, "foot", 1, 4.0, 0.0), (3, "head", 0, 0.0, 0.0)], "d long, part string, seq int, x double, y double")
    got = sorted((r.d, r.page, r.part, r.seq, r.x, r.y) for r in Y.paginate(ops, bands, s, "d").collect())
    head, foot = [(2, p, "head", 0, 51.0, 22.0) for p in range(3)], [(2, p, "foot", 1, 54.0, 370.0) for p in range(3)]
    body = [(1, 0, "body", 0, 50.0, 65.0), (1, 0, "body", 2, 296.9, 60.0), (1, 1, "body", 1, 49.5, 65.0), (2, 0, "body", 0, 47.0, 60.0), (2, 2, "body", 1, 54.0, 67.0)]
    assert [(a, b, c, d, round(x, 6), round(y, 6)) for a, b, c, d, x, y in got] == sorted([*head, *foot, *body, (3, 0, "head", 0, 50.0, 20.0)])


def test_flow_breaks_before_what_does_not_fit(spark):
    s = sections(spark, (1, 0, 0, 220))
    flow = spark.createDataFrame([(1, 0.0, 30.0), (1, 90.0, 30.0), (1, 100.0, 30.0), (1, 300.0, 500.0)], "d long, y double, h double")
    assert sorted((r.y, r["column"], r.at) for r in Y.columns_of(flow, s, "d", "y", "h").collect()) == [(0.0, 0, 0.0), (90.0, 1, 0.0), (100.0, 1, 0.0), (300.0, 3, 0.0)]


def test_image_references(spark):
    rows = ["data:image/png;base64,xx", "DATA:IMAGE/JPEG,xx", "data:text/html,xx", "blob:1", "http://h/a.png", " //h/a.png", "\\\\h\\a.png", "dir/a%20b+c.png", "dir\\x.png", "50%.png", "a.png", "", None]
    got = [tuple(r.r) for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, s string").orderBy("k").select(I.image_reference(F.col("s")).alias("r")).collect()]
    inline, blocked = ("inline", None), ("blocked", None)
    assert got == [inline, inline, blocked, inline, blocked, blocked, blocked, ("file", "a b+c.png"), ("file", "x.png"), ("file", "50%.png"), ("file", "a.png"), ("file", ""), ("file", "")]


def test_files_by_name_then_by_lower_case(spark):
    files = spark.createDataFrame([(1, "A.png", "z"), (1, "a.PNG", "y"), (1, "A.png", "x"), (1, "b.png", "b"), (2, "c.png", "c"), (1, None, "n")], "d long, name string, path string")
    refs = spark.createDataFrame([(1, "A.png", 0), (1, "a.png", 1), (1, "B.PNG", 2), (1, "c.png", 3), (1, None, 4), (None, "c.png", 5), (2, "c.png", 6), (2, "c.png", 7)], "d long, name string, k int")
    made = J.named_file(refs, files, ["d"], "name", "path")
    assert {r.k: r.path for r in made.collect()} == {0: "x", 1: "x", 2: "b", 3: None, 4: None, 5: None, 6: "c", 7: "c"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_budget_over_blocks(spark):
    rows = [("a", k, k % 7 + 1) for k in range(200)] + [(None, k, 5) for k in range(30)] + [("a", None, 2), ("b", 10, None), ("b", 11, 300), ("b", 12, 1)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r.g, r.k): r.kept for r in A.running_budget(df, ["g"], "k", "n", 300, block=16).collect()}
    for g in ("a", "b", None):
        total = 0
        for _, k, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)):
            assert got[g, k] == (total < 300)
            total += n or 0


def test_heads_and_feet_leave_the_body(spark):
    kind = "doc_id long, page_index long, line_id long, text string, x double, y double, w double, h double, page_width double, page_height double, rotated boolean"
    rows = []
    for p in range(4):
        rows += [(1, p, 0, "Report 2024", 50.0, 20.0, 100.0, 10.0, 600.0, 800.0, False), (1, p, 1, "left", 50.0, 32.0, 30.0, 10.0, 600.0, 800.0, False), (1, p, 2, f"body {'abcd'[p]}", 50.0, 300.0, 200.0, 10.0, 600.0, 800.0, False), (1, p, 3, str(p), 300.0, 780.0, 10.0, 10.0, 600.0, 800.0, False)]
    lines = spark.createDataFrame(rows, kind)
    running = R.repeated_lines(lines)
    assert sorted((r.page_index, r.text) for r in R.without(lines, running).collect()) == [(p, f"body {'abcd'[p]}") for p in range(4)]
    made = {(r.page_index, r.part): (r.lines, r.x, r.y, r.w, r.h, r.text) for r in R.furniture(running).collect()}
    assert made[2, "head"] == (2, 50.0, 20.0, 100.0, 22.0, "Report 2024\nleft") and made[3, "foot"] == (1, 300.0, 780.0, 10.0, 10.0, "3") and len(made) == 8
    assert R.furniture(running.limit(0)).collect() == []
