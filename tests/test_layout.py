"""Golden cases of page layout, sequences and joins."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumite.operators import aggregates as A
from vellumite.operators import blocks as B
from vellumite.operators import boilerplate as R
from vellumite.operators import joins as J
from vellumite.operators import pages as P
from vellumite.operators import sequences as S
from vellumite.operators import tables as G
from vellumite.streaming import progress


def span(text, x, baseline, size=10.0, width=None, **more):
    return {"text": text, "x": float(x), "y": baseline - 0.8 * size, "w": float(width if width is not None else 0.55 * size * len(text)), "h": size, "baseline": float(baseline), "font_size": size, "page_width": 595.0, **more}


def spans(*rows):
    return pd.DataFrame(rows).assign(seq=range(len(rows)))


def column(x, n, top=100, width=200, text="word word word word"):
    return [span(text, x, top + 14 * i, width=width) for i in range(n)]


def test_lines_by_baseline():
    lines, _ = P.page_lines(spans(span("本地", 60, 100, width=20), span("转换", 80, 100.2, width=20), span("next", 60, 114)))
    assert lines.text.tolist() == ["本地转换", "next"]


def test_superscript_stays_in_line():
    assert len(P.page_lines(spans(span("E=mc", 60, 100, 12), span("2", 90, 96.5, 7)))[0]) == 1


def test_rotated_spans_are_lines_of_their_own():
    lines, _ = P.page_lines(spans(span("a", 60, 100, rotation=0.0), span("b", 70, 100, rotation=90.0)))
    assert len(lines) == 2


def test_two_columns_left_first():
    page = spans(*column(60, 8), *column(320, 8))
    lines, bands = P.page_lines(page)
    parts, sure = P.regions(lines, 595.0, bands)
    assert len(lines) == 16 and [lines.x[p].iloc[0] for p in parts] == [60, 320] and 0.5 <= sure <= 1


def test_title_above_columns_comes_first():
    page = spans(span("Title", 60, 60, 18, 460), *column(60, 8), *column(320, 8))
    parts, _ = P.regions(*(lambda r: (r[0], 595.0, r[1]))(P.page_lines(page)))
    assert [len(p) for p in parts] == [1, 8, 8]


def test_narrow_gutter_between_long_lines():
    lines, bands = P.page_lines(spans(*column(60, 8), *column(272, 8)))
    assert len(lines) == 16 and len(bands) == 1


def test_number_columns_are_no_gutter():
    rows = [span("123", x, 100 + 14 * i, width=20) for i in range(8) for x in (60, 84, 108)]
    lines, bands = P.page_lines(spans(*rows))
    assert bands == [] and len(lines) == 8


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.integers(5, 90)), min_size=1, max_size=40), st.integers(-50, 50))
def test_every_span_is_in_one_line_wherever_the_page_lies(places, shift):
    page = spans(*[span("word", x, y + 20, width=w) for x, y, w in places])
    lines, bands = P.page_lines(page)
    parts, _ = P.regions(lines, 595.0, bands)
    assert lines.spans.sum() == len(places) and sorted(i for p in parts for i in p) == list(range(len(lines)))
    moved = page.assign(x=page.x + shift, y=page.y + shift, baseline=page.baseline + shift)
    assert P.page_lines(moved)[0].text.tolist() == lines.text.tolist()


def test_grouped_functions_agree_with_the_page_ones(spark):
    page = spans(*column(60, 8), *column(320, 8)).assign(doc_id=1, page_index=0)
    both = pd.concat([page, page.assign(page_index=1)])
    got = P.reading_order(spark.createDataFrame(both)).toPandas()
    assert got.groupby("page_index").size().tolist() == [16, 16] and got[got.page_index == 0].sort_values("position").x.tolist() == [60.0] * 8 + [320.0] * 8
    assert P.build_lines(spark.createDataFrame(both)).count() == 32


def lines_of(*rows):
    return [(1, 0, i, t, float(x), float(w), float(b), float(s)) for i, (t, x, w, b, s) in enumerate(rows)]


LINES = "doc_id long, page_index int, seq int, text string, x double, w double, baseline double, font_size double"


def test_paragraphs_lists_and_headings(spark):
    rows = lines_of(("Title of it", 60, 120, 60, 16), ("Body text runs on", 60, 300, 100, 10), ("and on to here", 60, 300, 114, 10), ("Another one", 60, 300, 150, 10), ("1. item", 60, 80, 164, 10))
    got = B.classify_blocks(B.paragraph_breaks(spark.createDataFrame(rows, LINES)), 10.0).orderBy("block").collect()
    assert [(r.kind, r.lines) for r in got] == [("heading", 1), ("paragraph", 2), ("paragraph", 1), ("list-item", 1)] and got[0].level == 2


def test_running_heads(spark):
    rows = [(1, p, 3 * p + k, t, 72.0, y + j, 100.0, 10.0, 595.0, 842.0, False) for p, j in enumerate([0.0, 7.0, -5.0, 9.0]) for k, (t, y) in enumerate([("Annual Report", 40.0), (f"body {p}", 300.0), (f"- {p + 1} -", 780.0)])]
    schema = "doc_id long, page_index int, line_id int, text string, x double, y double, w double, h double, page_width double, page_height double, rotated boolean"
    got = R.repeated_lines(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_index, r.band) for r in got) == [(p, b) for p in range(4) for b in ("footer", "header")]
    assert R.repeated_lines(spark.createDataFrame([r for r in rows if r[1] < 2], schema)).count() == 0


def rule(orientation, position, start, end, raster=False):
    return {"orientation": orientation, "position": float(position), "start": float(start), "end": float(end), "raster": raster}


GRID = [*[rule("horizontal", y, 100, 300) for y in (100, 130, 160)], *[rule("vertical", x, 100, 160) for x in (100, 200, 300)]]
TEXT = [span(t, x, y) for t, x, y in (("a", 120, 118), ("b", 220, 118), ("c", 120, 148), ("d", 220, 148))]


def test_ruled_table():
    cells = G.page_tables(pd.DataFrame(GRID), pd.DataFrame(TEXT))
    assert cells[["row", "col", "text"]].values.tolist() == [[0, 0, "a"], [0, 1, "b"], [1, 0, "c"], [1, 1, "d"]] and cells.confidence.iloc[0] == 1


@pytest.mark.parametrize("change,shape", [((4, rule("vertical", 200, 130, 160)), (1, 2)), ((1, rule("horizontal", 130, 200, 300)), (2, 1))])
def test_merged_cells(change, shape):
    rules = list(GRID)
    rules[change[0]] = change[1]
    first = G.page_tables(pd.DataFrame(rules), pd.DataFrame(TEXT)).iloc[0]
    assert (first.row_span, first.col_span) == shape


def test_empty_and_raster_grids_are_no_tables(spark):
    big = [*[rule("horizontal", y, 100, 400, True) for y in (100, 130, 160, 190)], *[rule("vertical", x, 100, 190, True) for x in (100, 200, 300, 400)]]
    assert len(G.page_tables(pd.DataFrame(big), pd.DataFrame(TEXT[:2]))) == 0
    assert len(G.page_tables(pd.DataFrame(big).assign(raster=False), pd.DataFrame(TEXT[:2]))) == 9
    page = dict(doc_id=1, page_index=0)
    got = G.ruled_tables(spark.createDataFrame(pd.DataFrame(GRID).assign(**page)), spark.createDataFrame(pd.DataFrame(TEXT).assign(**page)))
    assert got.count() == 4


def test_box_groups_and_suppression(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 20.0, 20.0), (1, "b", 21.0, 0.0, 20.0, 20.0), (1, "c", 0.0, 21.0, 20.0, 20.0), (1, "d", 300.0, 300.0, 20.0, 20.0), (2, "e", 0.0, 0.0, 1.0, 1.0)], "page int, id string, x double, y double, w double, h double")
    got = {r.id: r.component for r in J.page_components(boxes, ["page"], "id", 3.0).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    shifted = boxes.withColumn("x", F.when(F.col("id") == "b", 2.0).otherwise(F.col("x")))
    assert {r.id for r in J.suppress(shifted, ["page"], "id", "id").collect()} == {"a", "c", "d", "e"}


def test_sizes(spark):
    rows = spark.createDataFrame([(1, s, w) for s, w in ((9.5, 5), (11.2, 5), (10.1, 60), (15.0, 4), (143.0, 1))], "doc int, size double, chars int")
    got = [r.snapped for r in A.snap_sizes(rows, ["doc"], "size", "chars").orderBy("size").collect()]
    assert got == pytest.approx([10.1, 10.1, 10.1, 15.0, 30.3])


def test_progress_buffer():
    samples = []
    for t in range(200):
        samples = progress.push_sample(samples, float(t), t)
    assert len(samples) == 61 and samples[0][1] == 139
    samples = []
    for k in range(8):
        samples = progress.push_sample(samples, 30.0 * k, k)
    assert len(samples) == 4 and samples[0][1] == 4
    samples = [(2.0 * k, k) for k in range(11)]
    assert [progress.remaining_seconds(samples, 100, t) for t in (20.0, 21.0)] == [180.0, 179.0]


def test_remaining_time_as_a_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{2 * k:02d}", k, 100) for k in range(11)]
    spark.createDataFrame(rows, "job_id long, at string, page int, total int").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, at timestamp, page int, total int").parquet(str(tmp_path / "in"))
    q = progress.remaining_time(stream).writeStream.format("memory").queryName("left").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("left").orderBy("page").collect()
    assert got[-1].seconds_left == 180.0 and got[-1].samples == 11


def test_newest_generation_only(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "item string, gen int, v string")
    assert {r.v for r in progress.latest_generation(df, "item", "gen").collect()} == {"y", "z"}


def test_islands_keep_first_row_apart(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a")], "d int, n int, v string")
    got = S.islands(df, ["d"], ["n"], lambda prev: ~F.col("v").eqNullSafe(prev("v")))
    assert [r.island for r in got.orderBy("n").collect()] == [1, 1, 2, 3]


def test_three_line_table():
    rules = pd.DataFrame([rule("horizontal", y, 72, 400) for y in (100, 118, 170)])
    rows = [span(f"c{r}{c}", x, y) for r, y in enumerate((95, 113, 130, 145)) for c, x in enumerate((80, 200, 320))]
    cells = G.row_tables(rules, pd.DataFrame(rows))
    assert (cells.row.max() + 1, cells.col.max() + 1, len(cells)) == (4, 3, 12) and cells.confidence.iloc[0] >= 0.6


def test_statement_with_a_wrapped_cell():
    rules = pd.DataFrame([rule("horizontal", y, 72, 400) for y in (100, 130, 160)])
    rows = [span("A long", 80, 112), span("name", 80, 124), span("10", 200, 112), span("20", 320, 112), span("B", 80, 148), span("30", 200, 148), span("40", 320, 148)]
    cells = G.row_tables(rules, pd.DataFrame(rows))
    assert len(cells) == 6 and cells.text.iloc[0] == "A long name"


def test_plain_text_between_rules_is_no_table():
    rules = pd.DataFrame([rule("horizontal", y, 72, 400) for y in (100, 170)])
    rows = [span("plain text runs across the page here", 80, y, width=300) for y in (115, 130, 145)]
    assert len(G.row_tables(rules, pd.DataFrame(rows))) == 0
