"""Best-fit packing, run detection and fill-in-the-middle against versions that share no code with them."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellumite.llm import bestfit, fim, packing, periods
from vellumite.llm.queries import ORACLES, QUERIES, planted, tokenizer_file

ROOT = os.environ.get("TESTDATA", "/root/testdata")
SMALL = f"{ROOT}/sf0.001"
SCHEMA = "doc_id long, text string, piece string, n string, _id string, runs string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, "x", "y", "z", None) for k, t in rows], SCHEMA).repartition(parts)


READER = []


def ids_of(text, end):
    from tokenizers import Tokenizer

    if not READER:
        READER.append(Tokenizer.from_file(tokenizer_file()))
    return [*READER[0].encode(text or "", add_special_tokens=False).ids, end]


ODD = ["", None, "a", "a  b\n\n\tc", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "ünïcödé 中文 😀", "end<|endoftext"]


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, "a" * 1_000_000, "!" * 1_000_000, *[t or "" for t in ODD]], ids=lambda t: t[:3] + str(len(t)))
def test_ids_are_those_of_the_plain_call(text):
    encoder = packing.Encoder(tokenizer_file())
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == ids_of(text, 0)[:-1]


def plain_best_fit(sizes, window):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= s
        else:
            rooms.append(window - s)
    return sorted(rooms)


def test_best_fit_over_counts_is_best_fit_item_by_item():
    draw = random.Random(5)
    for window in (1, 2, 7, 20, 50):
        for _ in range(150):
            sizes = [draw.randint(1, window) for _ in range(draw.randint(0, 60))]
            moves, bins = bestfit.best_fit(dict(Counter(sizes)), window)
            assert sorted(window - f for _, n, f in bins for _ in range(n)) == plain_best_fit(sizes, window)
            held, items = defaultdict(list), Counter()
            for size, item, n, per, first, before in moves:
                for j in range(n):
                    held[first + j // per].append((before + j % per * size, size))
                    items[size, item + j] += 1
            assert set(items.values()) <= {1} and Counter(s for s, _ in items) == Counter(sizes)
            fills = {first + j: f for first, n, f in bins for j in range(n)}
            for k, inside in held.items():
                at = 0
                for offset, size in sorted(inside):
                    assert offset == at
                    at += size
                assert at == fills[k] <= window


def checked(rows, texts, window, end):
    """Every id of every text lies in exactly one piece, pieces in sequences without gaps; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {k for k, _ in texts}
    for key, text in texts:
        ids = ids_of(text, end)
        pieces = sorted(by_doc[key], key=lambda p: p.start)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert len(pieces) == -(-len(ids) // window) and all(p.length == window for p in pieces[1:])
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


@pytest.mark.parametrize(("block", "fan", "slack"), [(65_536, 16, 2), (5, 2, 0), (3, 3, 4)])
def test_hierarchy_packs_all_of_odd_texts(spark, block, fan, slack):
    draw = random.Random(9)
    texts = [*enumerate(ODD), *((100 + k, " ".join(draw.choices("red green blue 12 ! été".split(), k=draw.choice([1, 3, 10, 40, 90])))) for k in range(150))]
    rows = bestfit.pack(frame(spark, texts, 4), tokenizer_file(), window=64, block=block, fan=fan, slack=slack).collect()
    total = sum(len(ids_of(t, 0)) for _, t in texts)
    sizes = [n for _, t in texts for n in [len(ids_of(t, 0)) % 64] if n]
    whole = sum(len(ids_of(t, 0)) // 64 for _, t in texts)
    made = checked(rows, texts, 64, 0)
    assert -(-total // 64) <= made <= 1.12 * (whole + len(plain_best_fit(sizes, 64))) + 1


@pytest.mark.parametrize(("block", "fan", "most"), [(1, 128, 60), (7, 2, 80)])
def test_blocks_of_long_and_of_short_pieces_meet_above(spark, block, fan, most):
    # what short pieces have joined in their block stays together, so only single ones find room beside long ones
    word = lambda n: " ".join(["a"] * (n - 1))
    assert len(ids_of(word(40), 0)) == 40
    rows = [(k, word(40 if k < 60 else 24)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    made = bestfit.pack(df, tokenizer_file(), window=64, block=block, fan=fan, slack=0).collect()
    assert 60 <= checked(made, rows, 64, 0) <= most


def test_packing_of_nothing_nulls_and_repeats(spark):
    assert bestfit.pack(frame(spark, []), tokenizer_file()).collect() == []
    rows = bestfit.pack(frame(spark, [(None, "a"), (None, "a"), (3, "b"), (3, "b")]), tokenizer_file()).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == [(0, 0, 0, 2), (0, 0, 0, 2), (3, 0, 0, 2), (3, 0, 0, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    with pytest.raises(ValueError):
        bestfit.pack(frame(spark, []), tokenizer_file(), window=0)


def plain_runs(words, min_exp, least):
    """By the definition: each stretch, its smallest period, and whether a neighbour goes on with it."""
    n, out = len(words), []
    for i in range(n):
        for j in range(i + least, n + 1):
            q = next(q for q in range(1, j - i + 1) if all(words[k] == words[k + q] for k in range(i, j - q)))
            if j - i >= max(least, min_exp * q) and not (i > 0 and words[i - 1] == words[i - 1 + q]) and not (j < n and words[j] == words[j - q]):
                out.append((i, j - i, q))
    return out


def plain_collapse(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def run_texts():
    draw = random.Random(3)
    made = [[draw.choice("ab" if k % 2 else "abc") for _ in range(draw.randint(0, 34))] for k in range(60)]
    for _ in range(40):
        period = [draw.choice("abcd") for _ in range(draw.randint(1, 7))]
        made.append([draw.choice("abcd") for _ in range(draw.randint(0, 9))] + (period * 6)[: draw.randint(6, 36)] + [draw.choice("abcd") for _ in range(draw.randint(0, 6))])
    return [(k, draw.choice([" ", "\n", " \t "]).join(w)) for k, w in enumerate(made)]


@pytest.mark.parametrize(("min_exp", "least", "lags"), [(4, 6, 4096), (4, 6, 2), (2, 4, 4096), (3, 20, 1)])
def test_runs_by_the_definition(spark, min_exp, least, lags):
    texts = [*run_texts(), (900, None), (901, ""), (902, " \n "), (903, "w"), (904, "\xa0x \x1cy")]
    got = {r.doc_id: r for r in periods.find(frame(spark, texts), min_exp=min_exp, least_words=least, lags=lags).collect()}
    assert len(got) == len(texts)
    for key, text in texts:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        runs = plain_runs(words, min_exp, least)
        assert [tuple(r) for r in got[key].runs] == sorted(runs, key=lambda r: (r[0], r[2])), text
        assert got[key].n_words == len(words) and got[key].collapsed == plain_collapse(words, runs)


def test_sampled_lags_find_every_run_of_longer_texts():
    draw = random.Random(8)
    for n, p, times in ((900, 100, 4), (2500, 37, 9), (3000, 500, 5), (700, 1, 600), (1200, 3, 8)):
        words = [draw.randrange(40) for _ in range(n)]
        at, span = draw.randrange(n - p * times + 1), p * times
        for i in range(at + p, at + span):
            words[i] = words[i - p]
        ids, want = np.array(words, np.int32), {}
        for lag in range(1, n // 4 + 1):
            i = 0
            while i < n - lag:
                j = i
                while j < n - lag and words[j] == words[j + lag]:
                    j += 1
                if j - i + lag >= max(6, 4 * lag):
                    want.setdefault((i, j - i + lag), lag)
                i = j + 1
        assert periods.scan(ids, 1, n) == want and p in want.values()
        parts = {}
        for low in range(1, n // 4 + 1, 60):
            for run, lag in periods.scan(ids, low, low + 60).items():
                parts[run] = min(lag, parts.get(run, lag))
        assert parts == want


def test_runs_of_nothing_repeats_and_one_word_over_and_over(spark):
    assert periods.find(frame(spark, [])).collect() == []
    rows = periods.find(frame(spark, [(None, "a a a a a a"), (1, "a a a a a a"), (1, "b")])).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == [(0, 6, [(0, 6, 1)], "a"), (1, 1, [], "b"), (1, 6, [(0, 6, 1)], "a")]
    long = periods.find(frame(spark, [(1, "w " * 20_000), (2, "v" * 200_000)])).collect()
    assert sorted((r.n_words, [tuple(x) for x in r.runs], len(r.collapsed)) for r in long) == [(1, [], 200_000), (20_000, [(0, 20_000, 1)], 1)]
    with pytest.raises(ValueError):
        periods.find(frame(spark, []), min_exp=1)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the standard tables")
def test_op12_digests(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {}
    for r in docs.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts[r.doc_id] = words
    assert {r.doc_id: (r.text or "").split() for r in planted(docs).collect()} == {k: " ".join(w).split() for k, w in texts.items()}
    got = QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        words = texts[r.doc_id]
        runs = []
        for (s, n), p in slow_runs(words).items():
            runs.append((s, n, p))
        runs.sort(key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()


def slow_runs(words):
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([numbers[w] for w in words], int), {}
    for lag in range(1, len(words) // 4 + 1):
        same, i = (ids[:-lag] == ids[lag:]).tolist(), 0
        while True in same[i:]:
            i = same.index(True, i)
            j = same.index(False, i) if False in same[i:] else len(same)
            if j - i + lag >= max(6, 4 * lag):
                found.setdefault((i, j - i + lag), lag)
            i = j
    return found


def test_rank_and_select():
    draw = random.Random(2)
    for text in ("", "a", "é", "a" * 511 + "é", "中" * 600, "x" * 512, "".join(draw.choices("aé中😀", k=3000))):
        data = text.encode()
        held, begins = fim.Boundaries(np.frombuffer(data, np.uint8)), [0]
        for c in text:
            begins.append(begins[-1] + len(c.encode()))
        at = np.arange(len(data) + 1)
        assert held.rank(at).tolist() == [sum(b < k for b in begins[:-1]) for k in at] if len(data) < 700 else held.rank(np.array(begins)).tolist() == list(range(len(text) + 1))
        if text:
            assert held.select(np.arange(len(text))).tolist() == begins[:-1]


def plain_fim(key, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_fill_in_middle_of_odd_texts(spark):
    from pyspark.sql import functions as F

    draw = random.Random(4)
    odd = ["", None, "<P>", "a<S>b", "x<M", "<", "<S", "P>", "😀", "中文\n", "a" * 200_000, "é😀" * 50_000, "\x00\x01"]
    texts = [*enumerate(odd), (None, "null key"), (7, "again"), (7, "again"), *((100 + k, "".join(draw.choices("<>PSM aé中😀\n", k=draw.randint(0, 1300)))) for k in range(300))]
    made = fim.transform(frame(spark, texts))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in got) == Counter((k, *plain_fim(k, t)) for k, t in texts)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((k, t or "") for k, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(frame(spark, [])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the standard tables")
def test_op13_equals_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = db.execute(ORACLES["op13_fill_in_middle"]).fetchall()
    assert {r[0]: r[1:] for r in want} == {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_fill_in_middle"](spark, SMALL).collect()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the standard tables")
def test_op11_pieces(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_doc, held, total = defaultdict(list), Counter(), 0
    for r in QUERIES["op11_best_fit_packing"](spark, SMALL).collect():
        by_doc[r.doc_id].append(r)
        held[r.sequence_id] += r.length
    for key, text in documents.items():
        ids, at = ids_of(text, 0), 0
        for p in sorted(by_doc[key], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    assert max(held.values()) <= 2048 and len(held) <= -(-total // 2048) + 1


def test_rows_of_a_repeated_key_tie_their_components(spark):
    from vellumite.llm import minhash

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (7, b), (9, b + " more"), (11, c), (12, ""), (11, None), (None, a), (None, a), (20, "x y")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([(5, 5, True), (7, 5, False), (7, 5, False), (7, 5, False), (9, 5, False), (11, 11, True), (11, 11, True), (12, 12, True), (0, None, True), (0, None, True), (20, 20, True)], key=lambda r: (r[0], r[1] or 0))
    left = minhash.deduplicate(frame(spark, [*rows, (5, b)])).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(5, a), (11, None), (12, ""), (None, a), (None, a), (20, "x y")])
