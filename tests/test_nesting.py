"""Nested lists, grids, claims and insertion against folds written plainly, and on golden cases."""

import random

from vellumite.operators import nesting as E


def plain_lists(levels):
    """(parent, list, depth) of each item by a stack of open lists: [level, list, last item, parent]."""
    stack, out = [[levels[0], 0, None, None]], []
    for k, level in enumerate(levels):
        while len(stack) > 1 and level < stack[-1][0]:
            stack.pop()
        if k and level > stack[-1][0]:
            stack.append([level, k, None, stack[-1][2]])
        stack[-1][2] = k
        out.append((stack[-1][3], stack[-1][1], len(stack)))
    return out


def test_nested_lists(spark):
    draw = random.Random(1)
    cases = [[0], [0, 1, 1, 0], [2, 0, 1], [0, 3, 2, 1, 3, 0], [1, 3, 2, 2, 3, 0, 2], *([draw.randint(0, 5) for _ in range(draw.randint(1, 30))] for _ in range(40))]
    items = spark.createDataFrame([(d, k, v, k % 2 == 0) for d, levels in enumerate(cases) for k, v in enumerate(levels)], "doc long, seq int, level int, ordered boolean")
    got = E.nested_lists(items, ["doc"], "seq", "level", "ordered").collect()
    made = {(r.doc, r.seq): (r.parent, r.list, r.depth) for r in got}
    assert made == {(d, k): v for d, levels in enumerate(cases) for k, v in enumerate(plain_lists(levels))}
    assert all(r.list_ordered == (r.list % 2 == 0) for r in got)
    assert sorted((r.seq, r.position) for r in got if r.doc == 1) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_nested_lists_of_nothing_and_nulls(spark):
    kind = "doc long, seq int, level int, ordered boolean"
    assert E.nested_lists(spark.createDataFrame([], kind), ["doc"], "seq", "level", "ordered").collect() == []
    got = E.nested_lists(spark.createDataFrame([(None, 0, None, None), (None, 1, 99, True), (None, 2, 50, True)], kind), ["doc"], "seq", "level", "ordered").collect()
    assert sorted((r.seq, r.parent, r.depth) for r in got) == [(0, None, 1), (1, 0, 2), (2, 0, 2)]


CELL = "t long, k int, row int, col int, row_span int, col_span int, text string"


def test_grid_with_spans_overlaps_and_gaps(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 2, 1, "a"), (1, 1, 0, 1, 1, 2, "b"), (1, 2, 1, 0, 1, 1, "hidden"), (1, 3, 1, 2, None, 0, "c"), (1, 4, 0, 1, 1, 1, "b2"), (1, 5, None, 0, 1, 1, "lost"), (2, 0, 0, 0, 1, 1, "x")], CELL)
    got = E.dense_grid(cells, ["t"], "k").orderBy("t", "row", "col").collect()
    # b spans two columns, so that its second place stays covered though b2 came later and stands in the first
    assert [(r.t, r.row, r.col, r.row_span, r.col_span, r.text) for r in got] == [(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 1, "b2"), (1, 1, 1, 1, 1, None), (1, 1, 2, 1, 1, "c"), (2, 0, 0, 1, 1, "x")]
    flat = E.flattened(E.dense_grid(cells, ["t"], "k"), ["t"], "text").collect()
    assert {r.t: r.text for r in flat} == {1: "a b2 c", 2: "x"}
    assert E.dense_grid(spark.createDataFrame([], CELL), ["t"], "k").collect() == []


def test_cell_paragraphs(spark):
    rows = [(1, k, b, 10.0) for k, b in enumerate([100.0, 112.0, 124.0, 160.0, 172.0])] + [(2, 0, 10.0, 10.0), (2, 1, 25.0, 10.0), (3, 0, 10.0, 10.0), (3, 1, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "c int, seq int, baseline double, font_size double")
    got = {(r.c, r.seq): r.paragraph for r in E.cell_paragraphs(df, ["c"]).collect()}
    assert [got[1, k] for k in range(5)] == [1, 1, 1, 2, 2] and got[2, 1] == 1 and got[3, 1] == 1


def test_claims_roll_back(spark):
    draw = random.Random(2)
    pairs = [(g, c, draw.randint(0, 9)) for g in range(30) for c in range(8) for _ in range(draw.randint(1, 4))]
    df = spark.createDataFrame([*pairs, (0, None, 1), (0, 1, None)], "g int, c int, m int")
    want = {}
    for g in range(30):
        taken = set()
        for c in range(8):
            mine = {m for a, b, m in pairs if (a, b) == (g, c)} - taken
            want[g, c] = (len(mine) >= 2, sorted(mine) if len(mine) >= 2 else [])
            taken |= mine if len(mine) >= 2 else set()
    claimed = E.claims(df, ["g"], "c", "m", 2)
    assert {(r.g, r.c): (r.accepted, sorted(r.members)) for r in claimed.collect()} == want
    assert any(not ok for ok, _ in want.values())
    held = {(g, m) for (g, _), (_, ms) in want.items() for m in ms}
    assert {tuple(r) for r in E.unclaimed(df.where("c is not null and m is not null"), claimed, ["g"], "c", "m").collect()} == {(g, c) for g, c, m in pairs if (g, m) not in held}
    assert E.claims(df.limit(0), ["g"], "c", "m").collect() == []


def test_insertion_sees_what_was_inserted(spark):
    kind = "page int, id long, x double, y double, w double"
    blocks = spark.createDataFrame([(1, 10, 0.0, 0.0, 100.0), (1, 11, 0.0, 50.0, 100.0), (1, 12, 200.0, 50.0, 100.0), (2, 13, 0.0, 0.0, 10.0)], kind)
    # 2 and 1 both lie before 11, 1 above 2; 3 overlaps the right column only; 4 lies below everything; 5 is a page's only row
    items = spark.createDataFrame([(1, 1, 0.0, 45.0, 90.0), (1, 2, 0.0, 40.0, 90.0), (1, 3, 195.0, 20.0, 50.0), (1, 4, 0.0, 90.0, 90.0), (3, 5, 0.0, 0.0, 5.0)], kind)
    got = E.insert_by_position(blocks, items, ["page"], "id", "id").orderBy("page", "position").collect()
    assert [r.id for r in got if r.page == 1] == [10, 2, 1, 11, 3, 12, 4] and [r.id for r in got if r.page == 3] == [5] and [(r.id, r.item) for r in got if r.page == 2] == [(13, False)]


def test_insertion_by_a_plain_list(spark):
    draw = random.Random(6)
    rows = [(p, p * 100 + k, float(draw.randint(0, 300)), float(draw.randint(0, 300)), float(draw.randint(5, 120)), k % 3 == 0) for p in range(20) for k in range(25)]
    df = spark.createDataFrame(rows, "page int, id long, x double, y double, w double, item boolean")
    want = {}
    for p in range(20):
        held = [r for r in rows if r[0] == p and not r[5]]
        for r in (r for r in rows if r[0] == p and r[5]):
            over = lambda b, r=r: max(0, min(b[2] + b[4], r[2] + r[4]) - max(b[2], r[2])) / min(b[4], r[4])
            held.insert(next((k for k, b in enumerate(held) if b[3] >= r[3] and over(b) > 0.1), len(held)), r)
        want |= {(p, k): b[1] for k, b in enumerate(held)}
    got = E.insert_by_position(df.where("not item"), df.where("item"), ["page"], "id", "id").collect()
    assert {(r.page, r.position): r.id for r in got} == want
