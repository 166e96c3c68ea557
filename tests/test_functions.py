"""Golden cases of the text, number and image functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumite.functions import images as I
from vellumite.functions import numbers as N
from vellumite.functions import text as T
from vellumite.operators import sequences as S


def values(spark, made, rows, schema="t string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).withColumn("_n", F.monotonically_increasing_id())
    return [r[0] for r in df.select(made.alias("v"), "_n").orderBy("_n").collect()]


MARKERS = {"• 第一项": (False, "•", "bullet", "第一项"), "•若中考": (False, "•", "bullet", "若中考"), "1. 第一步": (True, "1.", "decimal", "第一步"), "a) 选项": (True, "a)", "letter", "选项"), "三、结论": (True, "三、", "other", "结论"), "① 首项": (True, "①", "other", "首项"), "（2）次项": (True, "（2）", "other", "次项"), "2024. 全年营收": None, "plain": None, "-x": None}


def test_list_markers(spark):
    got = values(spark, T.list_marker(F.col("t")), MARKERS)
    assert [tuple(g) if g else None for g in got] == list(MARKERS.values())


def test_section_numbers(spark):
    assert values(spark, T.section_depth(F.col("t")), ["3.2.1 版面分析", "4 结论", "3.14159 是圆周率", "1.2.3.4.5 deep", "12345 x"]) == [3, 1, None, None, None]
    assert values(spark, T.cjk_section_level(F.col("t")), ["一、背景", "（二）目标", "三 x"]) == [2, 3, None]


def test_joining_lines(spark):
    rows = [(["conver-", "sion"],), (["multi-", "Column"],), (["本地", "转换"],), (["one", "two", ""],), ([],), (["ends ", "here"],)]
    assert values(spark, T.join_lines(F.col("t")), rows, "t array<string>") == ["conversion", "multi- Column", "本地转换", "one two", "", "ends here"]


def test_sentence_end_and_clean_up(spark):
    assert values(spark, T.ends_sentence(F.col("t")), ["done.", "好。 ", "no", "", "a)", "x,"]) == [True, True, False, True, True, False]
    assert values(spark, T.sanitize(F.col("t")), ["a\x00b\x0b\tc\n�\x7f\x9f", "😀a"]) == ["ab\tc\n�", "😀a"]
    assert values(spark, T.utf16_length(F.col("t")), ["😀a"]) == [3]


RANGES = {"1-3, 5、8-": [0, 1, 2, 4, 7, 8, 9], "-2 4": [0, 1, 3], "3–1": [0, 1, 2], "9-20, 2, 2": [1, 8, 9], "50": None, "1-2-3": None, "": [], "  ": [], "x": None, "0": None, "12-": None}


def test_page_ranges(spark):
    assert values(spark, N.page_range(F.col("t"), F.lit(10)), RANGES) == list(RANGES.values())
    assert values(spark, N.page_range(F.col("t"), F.lit(3)), ["8-", "1-9007199254740991", "1-9007199254740992"]) == [None, [0, 1, 2], None]


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=20))
def test_ranges_round_trip(spark, pages):
    df = spark.createDataFrame([(1, p) for p in pages], "d int, p long")
    back = S.format_ranges(df, ["d"], "p").select(N.page_range(F.col("ranges"), F.lit(99)))
    assert back.first()[0] == sorted(pages)


def test_counters(spark):
    n = spark.createDataFrame([(28,), (14,), (2024,), (7,)], "n int")
    rows = n.select(*[T.counter(F.col("n"), s).alias(s) for s in ("upper-alpha", "lower-roman", "cjk-decimal", "decimal-leading-zero", "disc")]).collect()
    assert rows[0]["upper-alpha"] == "AB" and rows[1]["lower-roman"] == "xiv" and rows[2]["cjk-decimal"] == "二〇二四" and rows[3]["decimal-leading-zero"] == "07" and rows[0]["disc"] == "•"


def test_ucs2_and_names(spark):
    assert values(spark, T.ucs2_hex(F.col("t")), ["中a"]) == ["4e2d0061"]
    assert values(spark, T.safe_base_name(F.col("t")), ["a/b.docx", ".x", "plain"]) == ["a_b", "document", "plain"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["a.docx", "a.docx", "b", "b", "a.docx"])], "i int, name string")
    assert [r.unique_name for r in S.unique_names(df, [], "name", ["i"]).orderBy("i").collect()] == ["a.docx", "a (2).docx", "b", "b (2)", "a (3).docx"]


def test_rounding(spark):
    assert values(spark, N.round_half_up(F.col("t")), [-2.5, 2.5, -0.4], "t double") == [-2, 3, 0]
    assert values(spark, N.nearest_rank(F.col("t"), 0.3), [([1.0, 2.0, 3.0, 10.0],), ([3.0, 1.0, 2.0],), ([],)], "t array<double>") == [2.0, 2.0, 0.0]
    assert values(spark, N.clamp_int(F.col("t"), 1, 9, 5), [float("nan"), 12.0, 2.5], "t double") == [5, 9, 3]


def test_resize_plans(spark):
    w, h = F.col("w"), F.col("h")
    sizes = spark.createDataFrame([(4000, 3000), (800, 600)], "w int, h int")
    got = sizes.select(I.plan_resize(w, h, "long", 2000).alias("p")).select("p.width", "p.height", "p.changed").collect()
    assert [tuple(r) for r in got] == [(2000, 1500, True), (800, 600, False)]
    cover = sizes.select(I.plan_resize(w, h, "exact").alias("p")).first().p
    assert (cover.sx, cover.sw, cover.sh) == (500, 3000, 3000)
    contain = sizes.select(I.plan_resize(w, h, "exact", cover=False).alias("p")).first().p
    assert (contain.dw, contain.dh, contain.dx, contain.dy) == (800, 600, 0, 100)


def test_placing_images(spark):
    row = spark.createDataFrame([(300, 200, 100, 100)], "w int, h int, a int, b int")
    got = row.select(I.place_image(F.col("w"), F.col("h"), "fit").alias("p"), I.place_image(F.col("a"), F.col("b"), "letter", "portrait").alias("q")).first()
    assert (got.p.page_width, got.p.page_height, got.p.x) == (300, 200, 0) and (got.q.width, got.q.height, got.q.y) == (612, 612, 90)


@pytest.mark.parametrize("size,quality,fits", [(1000.0, 0.92, True), (100000.0, 0.3, False)])
def test_quality_search_ends(spark, size, quality, fits):
    got = spark.range(1).select(I.search_quality(lambda q: q * F.lit(size), F.lit(20000.0)).alias("f")).first().f
    assert (got.quality, got.fits) == (quality, fits)


def test_lines_of_a_paragraph_are_filtered_once(spark):
    """Not for every line anew: paragraphs of many lines took time in the square of their number."""
    lines = ["", "a hyphen-", "ated word", "次の", "行 ", "", "end", "of it"]
    df = spark.createDataFrame([(lines,)], "ls array<string>").select(T.join_lines(F.col("ls")).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("filter(ls") == 1
    assert df.first().t == "a hyphenated word次の行 end of it"
