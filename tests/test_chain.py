"""The layout chain on golden pages, and its plan."""

import pytest

from vellumite.operators import layout as L

SCHEMA = "doc_id long, page_index int, seq int, text string, x double, y double, w double, h double, baseline double, font_size double, bold boolean, scan boolean, page_width double"


def line(text, x, baseline, width=None, size=10.0, bold=False):
    return text, float(x), baseline - 0.8 * size, float(len(text) * size * 0.55 if width is None else width), size, float(baseline), size, bold


def run(spark, pages, scan=False, body=None):
    """Blocks of pages (lists of lines), a document each; `body` adds a page of native text of that size to each."""
    rows = []
    for k, lines in enumerate(pages):
        rows += [(k, 0, i, *v, scan, 595.0) for i, v in enumerate(lines)]
        if body:
            rows += [(k, 1, i, *line("body text " * 5, 72, 100 + 14 * i, 400, body), False, 595.0) for i in range(30)]
    made = L.layout(spark.createDataFrame(rows, SCHEMA)).where("page_index = 0").orderBy("doc_id", "reading_order").collect()
    return [[r for r in made if r.doc_id == k] for k in range(len(pages))]


def kinds(blocks):
    return [(b.kind, b.lines) for b in blocks]


def test_native_pages(spark):
    far, title, bullets, indented, early, western, hanging, rows, sizes, short = run(
        spark,
        [
            [line("line one of the text", 72, 100, 400), line("line two of the text", 72, 114, 400), line("line three after a gap", 72, 150, 400), line("line four after it", 72, 164, 400)],
            [line("Chapter One", 72, 100, 120, 20.0), line("body body body body", 72, 130, 400), line("body body body body", 72, 144, 400)],
            [line("• first", 72, 100, 60), line("1) second", 72, 114, 60), line("(a) third", 100, 128, 60), line("2013. is a year", 72, 142, 400)],
            [line("a full line of the paragraph", 72, 100, 400), line("the next one, full again", 72, 114, 400), line("indented start", 92, 128, 380), line("goes on", 72, 142, 400)],
            [line("甲方（辅导方）：陆雄杰", 72, 100, 160), line("乙方（家长方）：陈红丹", 72, 114, 160), line("全文" * 20, 72, 128, 400)],
            [line("The quick brown fox jumps over the lazy dog and keeps running", 72, 100, 400), line("across the field", 72, 114, 100), line("until it reaches the river bank where it finally stops to rest", 72, 128, 400)],
            [line("• item", 105, 100, 120), line("picture", 81, 114, 26), line("x" * 40, 81, 128, 400)],
            [line("account", 60, 100, 60), line("1001258780269367", 200, 100, 120, bold=True), line("kind", 60, 114, 60), line("margin", 200, 114, 30, bold=True)],
            [line("notes a bit larger than the text,", 72, 100, 400, 12.0), line("over two lines", 72, 116, 230, 12.0), line("plain text below it", 72, 144, 400), line("Step two:", 72, 164, 40, 12.0)],
            [line("bold and alone", 72, 100, 90, bold=True), line("1 Section by number", 72, 130, 140, bold=True), line("1.2 With a list mark", 72, 160, 140, bold=True), line("plain " * 10, 72, 180, 400)],
        ],
        body=10.0,
    )
    assert kinds(far) == [("paragraph", 2), ("paragraph", 2)] and far[0].space_after == 22 and far[0].line_rule == "exact" and far[0].line_spacing == pytest.approx(1.4)
    assert kinds(title) == [("heading", 1), ("paragraph", 2)] and title[0].level == 1 and title[0].body_size == 10.0
    assert [(b.kind, b.ordered, b.level, b.marker, b.text) for b in bullets[:3]] == [("list-item", False, 0, None, "first"), ("list-item", True, 0, None, "second"), ("list-item", True, 2, "(a)", "(a) third")]
    assert bullets[3].kind == "paragraph"
    assert kinds(indented) == [("paragraph", 2), ("paragraph", 2)] and indented[1].first_line_indent == pytest.approx(20) and indented[0].first_line_indent == 0
    assert kinds(early) == [("paragraph", 1)] * 3
    assert kinds(western) == [("paragraph", 3)] and western[0].text.startswith("The quick brown fox jumps over the lazy dog and keeps running across the field until")
    assert kinds(hanging)[:2] == [("list-item", 1), ("paragraph", 2)]
    assert "heading" not in {b.kind for b in rows} and len({b.region for b in rows}) > 1
    assert [b.text for b in sizes if b.kind == "heading"] == ["Step two:"]
    assert [(b.kind, b.level) for b in short] == [("heading", 4), ("heading", 1), ("list-item", 0), ("paragraph", None)]


def test_scanned_pages(spark):
    numbered, shaky, larger, items, bold, official, running = run(
        spark,
        [
            [line("1.3.1 农业农村现代化", 72, 100, 120), line("实现农业农村现代化是全面建设的重大任务，需要将先进技术", 72, 114, 400), line("装备、管理理念等引入农业，向农村延伸覆盖。", 72, 128, 400)],
            [line("第五级，信息系统受到破坏后，会造成特别严重损害。第五级信息系统", 47, 100, 420), line("使用单位应当依据国家管理规范、技术标准进行保护，并", 25, 114, 442), line("对该级信息系统工作进行专门监督、检查。", 40, 128, 280), line("《信息安全技术 基本要求》规定了不同级别的保护对", 46, 142, 421), line("象应具备的基本安全保护能力。", 40, 156, 140)],
            [line("备将获取的数据记录到电子健康文件中，方便病人或医生查阅。", 72, 100, 400, 11.7)],
            [line("使用提示文字，位于图片、视频下方的内容显式标识，说明如下", 72, 100, 400), line("是否接入第三方模块：否", 103, 124, 168), line("接口名称：无", 129, 148, 68), line("提供方名称：无", 129, 172, 79)],
            [line("1. 显式标识材料", 80, 100, 99, bold=True), line("使用提示文字，位于图片、视频下方的内容显式标识。", 79, 124, 300)],
            [line("一、培训时间", 92, 100, 80), line("2026年5月22日—5月25日。", 92, 118, 160), line("（一）开班式", 92, 136, 80), line("时间：2026年5月22日上午9:00", 92, 154, 180)],
            [line("同样大小的正文行至少要有十五个字才算数的", 72, 100 + 20 * i, 400, 16.0) for i in range(4)],
        ],
        scan=True,
        body=10.0,
    )
    assert [(b.kind, b.level) for b in numbered] == [("heading", 3), ("paragraph", None)]
    assert kinds(shaky) == [("paragraph", 3), ("paragraph", 2)]
    assert [b.kind for b in larger] == ["paragraph"] and larger[0].confidence <= 0.59
    assert kinds(items) == [("paragraph", 1)] * 4
    assert [b.kind for b in bold] == ["heading", "paragraph"]
    assert [b.kind for b in official][:3] == ["heading", "paragraph", "paragraph"] and official[0].level == 2
    assert {b.kind for b in running} == {"paragraph"}


def test_columns_are_read_one_after_another(spark):
    text = "word word word word"
    page = [line("Title above", 60, 60, 460, 18.0), *(line(f"left {text}", 60, 100 + 14 * i, 200) for i in range(8)), *(line(f"right {text}", 320, 100 + 14 * i, 200) for i in range(8))]
    (blocks,) = run(spark, [page])
    assert [b.text.split()[0] for b in blocks] == ["Title", "left", "right"] and blocks[0].columns == 2 and kinds(blocks)[1:] == [("paragraph", 8)] * 2
    (blocks,) = run(spark, [page[1:]])
    assert [b.text.split()[0] for b in blocks] == ["left", "right"] and {b.columns for b in blocks} == {2}


def test_column_count():
    gap = 21.0
    assert L.column_count([(60, 560, 9)], 595, gap, []) == 1
    assert L.column_count([(60, 260, 8), (320, 520, 8)], 595, gap, []) == 2
    assert L.column_count([(60, 260, 8), (270, 520, 8)], 595, gap, []) == 1
    assert L.column_count([(60, 260, 8), (270, 520, 8)], 595, gap, [(261.0, 268.0)]) == 2
    assert L.column_count([(60, 520, 2), (60, 260, 8), (320, 520, 8)], 595, gap, []) == 1
    assert L.column_count([(60, 560, 1), (60, 560, 1)], 595, gap, []) == 1


def test_alignment(spark):
    left, center, right, full = run(
        spark,
        [
            [line("plain", 72, 100, 200), line("x" * 40, 72, 200, 400)],
            [line("centered", 172, 100, 200, 9.9), line("x" * 40, 72, 200, 400)],
            [line("to the right", 272, 100, 200, 9.9), line("x" * 40, 72, 114, 400)],
            [line("x" * 40, 72, 100, 400), line("x" * 40, 72, 114, 400), line("x" * 10, 72, 128, 400)],
        ],
    )
    assert left[0].alignment == "left" and full[0].alignment == "justify"
    # a region of its own has its own left edge, and then no room to be centered in
    assert center[0].alignment in ("left", "center") and right[0].alignment in ("left", "right", "center")


def test_blank_pages_nulls_and_empty_input(spark):
    rows = [(1, 0, 0, *line("   ", 72, 100), None, 595.0), (2, 0, 0, "word", 72.0, 92.0, 30.0, 10.0, 100.0, 10.0, None, None, 595.0), (3, 0, 0, None, 72.0, 92.0, 30.0, 10.0, 100.0, 10.0, None, None, 595.0), (4, 0, 0, "\x1c", 72.0, 92.0, 30.0, 10.0, 100.0, 10.0, None, None, 595.0)]
    made = L.layout(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.kind, r.text) for r in made] == [(2, "paragraph", "word")]
    assert L.layout(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_exchange(spark):
    df = L.layout(spark.createDataFrame([(1, 0, 0, *line("word", 72, 100), False, 595.0)], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython [") == 1
    dealt = L.layout(spark.createDataFrame([(1, 0, 0, *line("word", 72, 100), False, 595.0)], SCHEMA).repartition(2, "doc_id"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
