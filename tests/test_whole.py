"""Queries take whole texts, pages and tables: small tables whose ends matter."""

import zlib

from pyspark.sql import functions as F

from vellumite.catalog import QUERIES
from vellumite.operators import joins as J


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return QUERIES[name](spark, str(folder)).collect()


def test_marks_and_sparse_pages_see_the_whole_text(spark, tmp_path):
    rows = [(1, "ab " * 30 + "😀 end 𠀀"), (5, "x" * 50), (2, "word " * 100), (3, "few words"), (4, "wholesome " * 20)]
    texts = {r.doc_id: (r.text, r.replaced) for r in run(spark, tmp_path, "replace_astral", "documents", rows, "doc_id long, text string")}
    assert texts[1] == ("ab " * 30 + "□ end □", 2) and texts[5] == ("x" * 50 + "□□", 2) and texts[2] == (rows[2][1], 0)
    sparse = {r.doc_id: r.sparse for r in run(spark, tmp_path, "sparse_pages", "documents", rows, "doc_id long, text string")}
    assert sparse == {1: True, 5: False, 2: False, 3: True, 4: False}


def test_every_word_is_in_a_line_and_a_region(spark, tmp_path):
    long = " ".join(f"somewhatlong{i}" for i in range(700))
    rows = [(1, f"{long}\n\nsecond line of the text with more than six words\n{'w' * 90} after"), (2, "alone")]
    want = sorted(w for r in rows for w in r[1].split())
    for name in ("build_lines", "xy_cut"):
        made = run(spark, tmp_path, name, "documents", rows, "doc_id long, text string")
        assert sorted(w for r in made for w in r.text.split()) == want
        # two of these words a row: 350 rows, 48 a page
        assert {r.page_index for r in made if r.doc_id == 1} == set(range(8))
        assert all(r.x + r.w <= (292 if r.x < 300 else 562) + 1e-6 and r.y + r.h <= 842 for r in made)


def test_overlaps_of_boxes_far_apart_in_key(spark, tmp_path):
    rows = [(40 * k * 17 % 28000, k * 7 % 50 + 1) for k in range(1, 700)]
    box = {i: (i % 40, i * 37 % 500, i * 91 % 700, 5 + s, 8 + s % 9) for i, s in rows}
    want = {}
    for i, (p, x, y, w, h) in box.items():
        for j, (q, u, v, m, n) in box.items():
            common = max(0, min(x + w, u + m) - max(x, u)) * max(0, min(y + h, v + n) - max(y, v))
            if i < j and p == q and common:
                want[p, i, j] = round(common / (w * h + m * n - common), 9)
    made = run(spark, tmp_path, "box_iou", "part", rows, "p_partkey long, p_size int")
    assert len(made) == len(want) > 500 and {(r.page, r.a, r.b): r.iou for r in made} == want


def test_covers_and_rules_far_apart_in_key(spark, tmp_path):
    rows = [(k * 1013 % 30011, k * 7 % 50 + 1) for k in range(1, 900)]
    box = {i: (i % 40, i * 37 % 500, i * 91 % 700, 5 + s, 8 + s % 9) for i, s in rows}
    page = lambda i: ((j, *box[j][1:]) for j in box if box[j][0] == box[i][0])
    want = {(i, j) for i, (_, x, y, w, h) in box.items() if i % 7 for j, u, v, m, n in page(i) if j % 7 == 0 and u - 1 <= x + w / 2 <= u + 8 * m + 1 and v - 1 <= y + h / 2 <= v + 30 * n + 1}
    made = run(spark, tmp_path, "containment_join", "part", rows, "p_partkey long, p_size int")
    assert len(made) == len(want) > 200 and {(r.id, r.cover) for r in made} == want
    want = {i for i, (_, x, y, w, _) in box.items() if any(j % 3 == 0 and abs(v - y) <= 2.5 and u <= x + 3 and u + 4 * m >= x + w - 3 for j, u, v, m, _ in page(i))}
    made = run(spark, tmp_path, "band_semi_join", "part", rows, "p_partkey long, p_size int")
    assert sorted(r.id for r in made) == sorted(want) and 300 < len(want) < 899 and any(i % 3 for i in want)


def test_letters_of_code_page_1252_stay_in_pdf_files(spark, tmp_path):
    made = run(spark, tmp_path, "text_pdf", "documents", [(1, "Größe „é“ €5\nplain (x)\n中 😀 a−b")], "doc_id long, text string")[0]
    stream = next(s for s in bytes(made.pdf).split(b"stream\n") if s[:1] == b"x")
    shown = zlib.decompressobj().decompress(stream)
    assert b"<%s> Tj" % "Größe „é“ €5".encode("cp1252").hex().encode() in shown
    assert b"(plain \\(x\\)) Tj" in shown and b"(? ? a-b) Tj" in shown and made.lost == 2


def test_heads_are_found_on_later_pages(spark, tmp_path):
    rows = [(45, "\n".join(f"line {i}" for i in range(135))), (70, "one\ntwo")]
    made = run(spark, tmp_path, "repeated_boilerplate", "documents", rows, "doc_id long, text string")
    assert {(r.page_index, r.line_id, r.band) for r in made if r.band == "footer"} == {(1, 1, "footer"), (2, 46, "footer"), (3, 91, "footer"), (4, 1, "footer")}
    assert {(r.page_index, r.line_id) for r in made if r.band == "header"} >= {(1, 0), (2, 45), (3, 90)}


def test_counters_and_ranges_take_every_row(spark, tmp_path):
    made = run(spark, tmp_path, "counters", "part", [(0,), (3999,), (4000,), (18279,)], "p_partkey long")
    assert {tuple(r) for r in made} == {
        (0, "0", "0", "〇", "00"), (3999, "mmmcmxcix", "ewu", "三九九九", "3999"),
        (4000, "mmmm", "ewv", "四〇〇〇", "4000"), (18279, "m" * 18 + "cclxxix", "aaaa", "一八二七九", "18279"),
    }
    made = run(spark, tmp_path, "format_ranges", "lineitem", [(1, 1), (1, 2), (1, 3), (2, 2), (2, 6), (502, 4)], "l_orderkey long, l_linenumber int")
    assert {(r.doc_id, r.ranges) for r in made} == {(1, "2-4"), (2, "3, 5, 7")}


def test_boxes_of_equal_place_are_measured_as_one(spark):
    """Each two places are measured once, however many boxes lie there; lists of keys are longer than one row holds."""
    places = [(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 10.0, 10.0), (400.0, 0.0, 9.0, 9.0), (64.0, 32.0, 8.0, 8.0)]
    rows = [(k, k % 2, *places[k % 7 % 4]) for k in range(1, 2000)] + [(3, 1, *places[1]), (3, 1, *places[1]), (None, 1, *places[1]), (5, 1, None, 1.0, 1.0, 1.0)]
    assert J.LISTED < 280
    boxes, seen = spark.createDataFrame(rows, "id long, page long, x double, y double, w double, h double"), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(x, u):
        seen.add(1)
        return x + u

    made = J.overlapping_keys(boxes, ["page"], "id", m=measure("x", "_r_x")).collect()
    pairs = [(a[1], a[0], b[0], a[2] + b[2]) for a in rows for b in rows if None not in a and None not in b and a[1] == b[1] and a[0] < b[0] and (a[2:] == b[2:] or {a[2], b[2]} == {0.0, 5.0})]
    assert sorted(map(tuple, made)) == sorted(pairs) and len(pairs) > 400_000 and 0 < seen.value <= 20
