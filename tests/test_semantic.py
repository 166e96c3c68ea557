"""Sections, runs, margins, warnings, recognized text, raster rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumite.functions import documents as D
from vellumite.functions import ocr as O
from vellumite.operators import raster
from vellumite.operators import semantic as M


def test_sections_by_page_size(spark):
    pages = spark.createDataFrame([(1, i, w, 842.0) for i, w in enumerate((595.0, 595.3, 842.0, 595.0))], "doc_id long, page_index int, width double, height double")
    assert [(r.section, r.break_before) for r in M.sections(pages).orderBy("page_index").collect()] == [(1, False), (1, True), (2, False), (3, False)]


def test_runs_join_by_style(spark):
    spans = [("Hello", 0.0, 30.0, 10.0, False, False, "A"), ("world", 36.0, 30.0, 10.1, False, False, "A"), ("bold", 70.0, 20.0, 10.0, True, False, "A"), ("x", 90.5, 5.0, 12.0, True, False, "A")]
    df = spark.createDataFrame([(spans,), ([],)], "s array<struct<text:string,x:double,w:double,font_size:double,bold:boolean,italic:boolean,font_name:string>>")
    got = [r.r for r in df.select(M.line_runs(F.col("s")).alias("r")).collect()]
    assert [(r.text, r.bold, r.font_size) for r in got[0]] == [("Hello world", False, 10.0), (" bold", True, 10.0), ("x", True, 12.0)] and got[1] == []
    cut = df.select(M.strip_marker(M.line_runs(F.col("s")), F.lit(13)).alias("r")).first().r
    assert [r.text for r in cut] == ["old", "x"]


def test_spacing(spark):
    def spacing(pitch, size, largest, lines, page):
        return tuple(spark.range(1).select(D.line_spacing(F.lit(pitch).cast("double"), F.lit(size), F.lit(largest), F.lit(lines), F.lit(page)).alias("s")).first().s)

    assert spacing(17.0, 10.0, 10.0, 3, 0.0) == (1.7, "exact") and spacing(None, 10.0, 10.0, 1, 17.0) == (1.7, "exact") and spacing(None, 10.0, 10.0, 1, 0.0) == (1.15, "atLeast")
    step = spark.createDataFrame([(28.0,), (48.0,), (None,)], "s double")
    assert [r[0] for r in step.select(D.space_after(F.col("s"), F.lit(0.0), F.lit(28.0), F.lit(16.0))).collect()] == [0, 20, 0]


def test_margins_and_warnings(spark):
    blocks = spark.createDataFrame([(1, 0, 60.0, 5.0, 400.0, 20.0, 595.0, 842.0), (1, 0, 90.4, 300.0, 400.0, 20.0, 595.0, 842.0)], "doc_id long, page_index int, x double, y double, w double, h double, page_width double, page_height double")
    r = M.page_margins(blocks).first()
    assert (r.margin_left, r.margin_top, r.margin_right, r.margin_bottom) == (60.0, 18.0, 105.0, 108.0)
    w = spark.createDataFrame([(1, 0, "a", 0, {"k": "1"}), (1, 1, "a", 0, {"k": "1"}), (1, 2, "a", None, None)], "doc_id long, seq int, code string, page_index int, params map<string,string>")
    kept = M.distinct_warnings(w, w)
    assert kept.count() == 2
    mine, rest = M.split_warnings(kept, blocks)
    assert (mine.count(), rest.count()) == (1, 1)


def test_pitch(spark):
    rows = [(1, 0, 1, i, b) for i, b in enumerate((100.0, 117.0, 134.0))] + [(1, 1, 1, 0, 100.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block int, seq int, baseline double")
    assert [r.pitch for r in M.page_pitch(df).orderBy("page_index").collect()] == [17.0, 0.0]


@pytest.mark.parametrize("w,h,body,want", [(1215.0, 1715.0, 20.0, 595.28 / 1215), (213.0, 6000.0, 7.0, 1.5), (2400.0, 3000.0, 12.0, 8 / 12), (600.0, 850.0, 10.0, 1.0)])
def test_scan_scale(spark, w, h, body, want):
    got = spark.range(1).select(O.page_scale(F.lit(w), F.lit(h), F.lit(body), F.lit(True))).first()[0]
    assert got == pytest.approx(want)


def test_word_pages(spark):
    got = [tuple(spark.range(1).select(O.word_page(F.lit(w), F.lit(h)).alias("p")).first().p) for w, h in ((595.0, 842.0), (213.0, 11349.0), (3000.0, 2000.0))]
    assert got == [(595.0, 842.0, False), (595.28, 841.89, True), (1584.0, 1056.0, True)]


def test_recognized_sizes_and_strips(spark):
    rows = spark.createDataFrame([("汉" * 14, 140.0, 20.0, False), ("XMP-tc260", 90.0, 11.0, False), ("竖排", 20.0, 90.0, True)], "t string, w double, h double, v boolean")
    assert [r[0] for r in rows.select(O.font_size(F.col("t"), F.col("w"), F.col("h"), F.col("v"))).collect()] == pytest.approx([10, 9.9, 18])
    cut = [r[0] for r in spark.createDataFrame([(2000.0,), (500.0,)], "h double").select(O.strips(F.col("h"))).collect()]
    assert tuple(cut[0][0]) == (0.0, 720.0) and cut[0][-1].top + cut[0][-1].height == 2000.0 and [tuple(s) for s in cut[1]] == [(0.0, 500.0)]


def test_noise(spark):
    rows = spark.createDataFrame([(1, 0.15, False, 0.0, 0), (8, 0.9, True, 0.7, 100), (8, 0.95, False, 0.9, 100)], "n int, c double, t boolean, r double, i int")
    assert [r[0] for r in rows.select(O.noise(F.col("n"), F.col("c"), F.col("t"), F.col("r"), F.col("i"))).collect()] == [True, True, False]


def test_bullets(spark):
    rows = [(1, 0, 0, "o", 50.0, 104.0, 3.0, 3.0, 3.0, 0.4), (1, 0, 1, "first item of a list", 60.0, 100.0, 200.0, 10.0, 10.0, 0.9), (1, 0, 2, "o", 150.0, 203.0, 3.0, 3.0, 3.0, 0.4)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, seq int, text string, x double, y double, w double, h double, font_size double, confidence double")
    got = O.mark_bullets(df, ["doc_id", "page_index"]).orderBy("seq").collect()
    assert [(r.text, r.font_size) for r in got] == [("• ", 10.0), ("first item of a list", 10.0), ("o", 3.0)]


def test_raster_rules():
    page = np.zeros((600, 600), bool)
    for p in (100, 150, 200):
        page[p : p + 2, 100:402] = True
    for p in (100, 250, 400):
        page[100:202, p : p + 2] = True
    found = raster.rules(page, 1.0)
    assert found[found.orientation == "horizontal"].position.tolist() == [101, 151, 201] and found[found.orientation == "vertical"].position.tolist() == [101, 251, 401]
    assert len(raster.rules(np.ones((600, 600), bool), 1.0)) == 0


def test_messages(spark):
    df = spark.createDataFrame([("page {page} of {total} {x}", {"page": "3", "total": "9"}, 3723000, 1536)], "t string, p map<string,string>, ms long, n long")
    got = df.select(D.interpolate(F.col("t"), F.col("p")), D.clock(F.col("ms")), D.file_size(F.col("n")), D.page_image_name(F.lit("a"), F.lit(2), F.lit(120), "png")).first()
    assert tuple(got) == ("page 3 of 9 {x}", "1:02:03", "2 KB", "a-003.png")
