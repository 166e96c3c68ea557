"""Colours, case, symbol fonts, routing of files, images of pages, scaling of scans."""

from pyspark.sql import functions as F

from vellumite.functions import styles as K
from vellumite.operators import joins as J
from vellumite.operators import routing as Z


def values(spark, rows, f):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], ["k", *[f"c{i}" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)]])
    return [r.v for r in df.orderBy("k").select(f.alias("v")).collect()]


def test_colors(spark):
    got = values(spark, ["rgb(255, 0, 51)", "rgba(0,0,0,0)", "rgba(0, 0, 0, 0.02)", "rgba(10%, 20%, 100%, .5)", "transparent", "", "rgb(1,2)", None], K.color(F.col("c0")))
    assert [None if v is None else tuple(round(x, 6) for x in v) for v in got] == [(1.0, 0.0, 0.2), None, None, (0.1, 0.2, 1.0), None, None, None, None]


def test_case_and_classes(spark):
    got = values(spark, [("ab cd", "uppercase"), ("Ab", "lowercase"), ("ab  éf 1x\ty", "capitalize"), ("aB", "none")], K.transformed(F.col("c0"), F.col("c1")))
    assert got == ["AB CD", "ab", "Ab  Éf 1x\tY", "aB"]
    assert values(spark, [" ", "a", "é", "€", "中", "\t", "\u200b", "\x85"], K.char_class(F.col("c0"))) == ["latin"] * 4 + ["cjk", "skip", "skip", "skip"]


def test_symbol_fonts(spark):
    assert values(spark, ["ABCDEF+Wingdings-Regular", "SymbolMT", "ZapfDingbats", "Arial", None], K.is_symbol_font(F.col("c0"))) == [True, True, True, False, False]
    rows = [("Wingdings", "\uf0a8 a\uf0fc"), ("Symbol", "\uf0a8\uf0b3\uf06c"), ("Wingdings", "\ue06c\uf001"), ("Symbol", "plain")]
    assert values(spark, rows, K.symbol_text(F.col("c0"), F.col("c1"))) == ["□ a✓", "◊≥●", "●•", "plain"]


def test_routing(spark):
    batches = {
        1: [("a.pdf", ""), ("b.png", "image/png")], 2: [("note.md", ""), ("p.png", "image/png"), ("q.png", "image/png")], 3: [("p.png", ""), ("q.JPG", "")], 4: [("x.heic", "")], 5: [("x.xyz", "a/b"), (None, None)], 6: [("w.docx", "")],
        7: [("noext", "text/plain"), ("p.png", "")], 8: [("a.pdf", ""), ("c.pdf", ""), ("n.txt", "text/plain")],
    }
    df = spark.createDataFrame([(k, n, m) for k, files in batches.items() for n, m in files], "b int, name string, media string")
    got = {r.b: (r.tool, r.votes) for r in Z.route(df, ["b"]).collect()}
    assert got == {1: ("pdf-to-word", 1), 2: ("markdown-to-pdf", 3), 3: ("images-to-pdf", 2), 4: ("compress-images", 1), 5: (None, 0), 6: ("word-to-pdf", 1), 7: ("images-to-pdf", 1), 8: ("pdf-to-word", 2)}
    assert Z.route(df.limit(0), ["b"]).collect() == []


def test_images_that_become_blocks(spark):
    kind = "page int, id int, x double, y double, w double, h double, stored boolean, scan boolean, page_width double, page_height double"
    row = lambda page, id, x, y, w, h, stored=True, scan=False: (page, id, float(x), float(y), float(w), float(h), stored, scan, 600.0, 800.0)
    images = spark.createDataFrame([row(1, 1, 50, 50, 100, 100), row(1, 2, 110, 110, 50, 50), row(1, 3, 0, 0, 590, 790), row(1, 4, 0, 0, 11, 90), row(1, 5, 0, 0, 90, 90, False), row(2, 6, 0, 0, 590, 790, True, True), row(2, 7, 110, 110, 50, 50, True, True), row(3, 8, 0, 0, 50, 50, None), row(3, 9, 0, 0, 50, 50, True, None)], kind)
    tables = spark.createDataFrame([(1, 101.0, 109.0, 70.0, 60.0), (2, 100.0, 100.0, 100.0, 100.0)], "page int, x double, y double, w double, h double")
    assert sorted(r.id for r in J.image_blocks(images, tables, ["page"]).collect()) == [1, 3, 7, 9]


def test_scans_are_scaled_with_what_lies_on_them(spark):
    pages = spark.createDataFrame([(1, 1000.0, 1400.0, True), (2, 600.0, 800.0, False)], "page int, width double, height double, scan boolean")
    parts = spark.createDataFrame([(1, 10.0, 20.0, "a"), (2, 10.0, 20.0, "b"), (3, 10.0, 20.0, "c")], "page int, x double, size double, t string")
    sized, placed = J.scaled_scans(pages, parts, ["page"], ["x", "size"], F.when(F.col("scan"), 0.5).otherwise(1.0))
    assert {r.page: (r.width, r.height, r.scale) for r in sized.collect()} == {1: (500.0, 700.0, 0.5), 2: (600.0, 800.0, 1.0)}
    assert sorted((r.t, r.x, r["size"]) for r in placed.collect()) == [("a", 5.0, 10.0), ("b", 10.0, 20.0), ("c", 10.0, 20.0)]
