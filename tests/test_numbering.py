"""Numbering sheets, nested lists, grids, claims and insertion on golden cases and against folds written plainly."""

import random

from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.operators import numbering as N


def labelled(spark, css, classes):
    items = spark.createDataFrame([(1, k, c) for k, c in enumerate(classes)], "doc_id long, seq int, class string")
    made = N.labels(items, spark.createDataFrame([(1, css)], "doc_id long, css string"))
    return [r.label for r in made.orderBy("seq").collect()]


def test_labels_of_a_sheet(spark):
    css = r"""
    p.x-num-1-0:before { content: "" counter(x-num-1-0, decimal) "." "\9"; counter-increment: x-num-1-0; }
    p.x-num-1-1:before { content: ""counter(x-num-1-0, decimal)"."counter(x-num-1-1, decimal)"\9"; }
    p.x-num-2-0:before { content: "\f0b7 \9"; font-family: 'Symbol'; }
    p.x-num-4-0:before { content: " "; background: url(a.png); }
    p.x-num-6-0 { list-style-type: lower-roman }  p.x-num-6-1 { list-style-type: none }  h1 { color: red }
    :root { counter-reset: x-num-1-0 0 x-num-1-1 0 x-num-2-0; }"""
    classes = ["x-num-1-0", "x-num-1-1", "x-num-1-1", "x-num-1-0", "x-num-1-1", "x-num-2-0", "x-num-2-0", "x-num-4-0", "x-num-6-0", "x-num-6-1", "x-num-6-0", "other", None, "x-num-9-0"]
    assert labelled(spark, css, classes) == ["1.\t", "1.1\t", "1.2\t", "2.\t", "2.1\t", "\uf0b7\t", "\uf0b7\t", "•", "i ", "", "ii ", "", "", ""]
    rules, parts, starts = N.parse_sheets(spark.createDataFrame([(1, css), (2, None), (3, "")], "doc_id long, css string"))
    assert {r["class"]: r.font for r in rules.collect()}["x-num-2-0"] == "Symbol"
    assert {(r.counter, r.start) for r in starts.collect()} == {("x-num-1-0", 0), ("x-num-1-1", 0), ("x-num-2-0", 0)}


def test_other_levels_keep_their_own_style_and_starts_count_on(spark):
    css = 'p.x-num-3-0:before { content: ""counter(x-num-3-0, decimal)"."; } p.x-num-3-1:before { content: ""counter(x-num-3-0, lower-alpha)"."counter(x-num-3-1, lower-alpha)")"; } :root { counter-reset: x-num-3-0 0 x-num-3-1 0; }'
    assert labelled(spark, css, ["x-num-3-0", "x-num-3-1", "x-num-3-1"]) == ["1.", "1.a)", "1.b)"]
    css = "p.x-num-5-0:before { content: counter(x-num-5-0, upper-roman) ; } :root { counter-reset: x-num-5-0 3; } p.x-num-5-1:before { content: counter(x-num-5-1) } .y { counter-set: x-num-5-0 7; counter-set: x-num-5-0 8 }"
    # a counter without a start isn't reset by smaller levels
    assert labelled(spark, css, ["x-num-5-0", "x-num-5-1", "x-num-5-0", "x-num-5-1"]) == ["IX", "1", "X", "2"]


def test_labels_of_nothing(spark):
    assert labelled(spark, None, ["x-num-1-0"]) == [""] and labelled(spark, "", []) == []


def test_counters_in_words(spark):
    values = [0, 1, 9, 10, 11, 20, 21, 99, 100, 101, 110, 111, 205, 1000, 1001, 1010, 1100, 9999, 10000]
    df = spark.createDataFrame([(v,) for v in values], "n int")
    got = df.select("n", T.counter(F.col("n"), "cjk-ideographic").alias("a"), T.counter(F.col("n"), F.lit("simp-chinese-formal")).alias("b"), T.counter(F.col("n"), "katakana").alias("c")).collect()
    informal = {r.n: r.a for r in got}
    assert [informal[n] for n in values] == ["0", "一", "九", "十", "十一", "二十", "二十一", "九十九", "一百", "一百〇一", "一百一十", "一百一十一", "二百〇五", "一千", "一千〇一", "一千〇一十", "一千一百", "九千九百九十九", "10000"]
    assert {r.n: r.b for r in got}[21] == "贰十壹" and {r.n: r.c for r in got}[9] == "ケ" and {r.n: r.c for r in got}[1000] == "1000"



