"""The ten queries over the small standard tables, and the pipeline, against versions that share no code with them."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
import zstandard

import corpus_pipeline
from test_llm_operators import brute_components, brute_rules, brute_targets, table, texts
from vellumite.llm import langid, pii, quality_classifier, toxicity
from vellumite.llm.common import crc_bucket
from vellumite.llm.queries import ORACLES, QUERIES, SHARDS, SLOTS, tokenizer_file

ROOT = os.environ.get("TESTDATA", "/root/testdata")
SMALL = f"{ROOT}/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the standard tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def held(key, n):
    return zlib.crc32(str(key).encode()) % n


def rows_of(spark, name, folder=SMALL):
    df = QUERIES[name](spark, folder)
    return df.columns, df.collect()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_op1_recall_on_the_standard_tables(spark, size):
    if not os.path.isdir(f"{ROOT}/{size}"):
        pytest.skip("needs the table")
    _, got = rows_of(spark, "op1_nearest_neighbours", f"{ROOT}/{size}")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{ROOT}/{size}/embeddings.parquet").collect()}
    ids, matrix = np.array(list(vectors)), np.stack(list(vectors.values()))
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
        assert r.score == pytest.approx(float(np.linalg.norm(vectors[r.vec_id] - vectors[r.query_id])), abs=1e-12)
    assert set(found) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, rows in found.items():
        distance = np.sqrt(((matrix - vectors[q]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, distance))] if i != q][:10]
        assert [r.rank for r in rows] == list(range(1, 11))
        hits += len(set(best) & {r.vec_id for r in rows})
    assert hits >= 0.95 * 10 * len(found)


def test_op2_pieces_hold_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer_file())
    columns, got = rows_of(spark, "op2_packing")
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for key, pieces in by_doc.items():
        ids, at = [*reader.encode(documents[key].text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for number, pieces in by_window.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or number == max(by_window)
    assert sorted(by_window) == list(range(len(by_window)))


def test_op3_components(spark, documents):
    _, got = rows_of(spark, "op3_minhash")
    want = brute_components([(k, r.text) for k, r in documents.items()], 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_op4_counts_and_own_sql(spark, documents):
    import duckdb

    _, got = rows_of(spark, "op4_quality_rules")
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(documents[r.doc_id].text)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(ORACLES["op4_quality_rules"]).fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_op5_targets_and_takes(spark, documents):
    columns, got = rows_of(spark, "op5_mixing")
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    sizes, of = Counter(), {k: len(re.findall(WORD, r.text or "")) for k, r in documents.items()}
    for k, r in documents.items():
        sizes[r.source] += of[k]
    want, taken, members = brute_targets(sizes), Counter(), defaultdict(list)
    for r in got:
        s = documents[r.doc_id].source
        assert (r.size, r.source_size) == (of[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        members[s].append(r.size)
    assert len(got) == len(documents) and all(abs(taken[s] - want[s]) <= max(0.01 * want[s], np.median(members[s])) for s in sizes)
    again = rows_of(spark, "op5_mixing")[1]
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_op6_surrogates_are_one_to_one(spark, documents):
    """Entities found again by another regular expression library; texts around them stay, and forms map one to one."""
    _, got = rows_of(spark, "op6_pii")
    pattern, there, back, n = regex.compile(pii.ANY.replace("(?iu:", "(?i:"), regex.V0), {}, {}, 0
    for r in got:
        old = documents[r.doc_id].text
        found = [m for m in pattern.finditer(old or "")]
        assert r.n_entities == len(found)
        if not found:
            assert r.text == old
            continue
        at, rest = 0, r.text
        for k, m in enumerate(found):
            before = old[at : m.start()]
            assert rest.startswith(before)
            rest, at = rest[len(before) :], m.end()
            after = old[at : found[k + 1].start()] if k + 1 < len(found) else old[at:]
            end = rest.index(after) if after else len(rest)
            made, rest = rest[:end], rest[end:]
            key = m[0].lower() if "@" in m[0] or re.search("[g-z]", m[0].lower()) else re.sub(r"[^0-9a-f+.]", "", m[0].lower())
            assert there.setdefault(key, made.lower()) == made.lower() and made != m[0]
            assert re.sub(r"\w", "", m[0]) == re.sub(r"\w", "", made)
            n += 1
        assert rest == old[at:]
    for key, made in there.items():
        if not re.match(r"\W*(mr|ms|mrs|dr|herr|frau)", key):
            assert back.setdefault(made, key) == key
    assert n > 0


def test_op7_table_is_filled_in_turns(spark):
    _, got = rows_of(spark, "op7_sharding")
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    order = [[(number(f"{s}/offset") + k * (number(f"{s}/step") % (SLOTS - 1) + 1)) % SLOTS for k in range(SLOTS)] for s in SHARDS]
    owner, turn = {}, 0
    while len(owner) < SLOTS:
        slot = next(x for x in order[turn % len(SHARDS)] if x not in owner)
        owner[slot] = SHARDS[turn % len(SHARDS)]
        turn += 1
    for r in got:
        slot = number(str(r.doc_id)) % SLOTS
        assert (r.slot, r.shard) == (slot, owner[slot])


def learned_on(spark, n, rest, operator):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    known = crc_bucket(docs["doc_id"], n) != rest
    return operator.fit(docs.where(known), labels.where(crc_bucket(labels["doc_id"], n) != rest))


def test_op8_scores_are_the_softmax_of_mean_vectors(spark, documents):
    model, (_, got) = learned_on(spark, 5, 0, quality_classifier), rows_of(spark, "op8_quality_classifier")
    assert len(got) == len(documents)
    for r in got:
        ids, words = [], (documents[r.doc_id].text or "").split()
        for i, w in enumerate(words):
            if i and words[i - 1] == w:
                ids.append(0)
            marked = f"<{w}>"
            grams = [f" {w}", *dict.fromkeys(marked[a : a + n] for n in (3, 4) for a in range(len(marked) - n + 1))]
            ids += [1 + xxhash.xxh32_intdigest(g.encode("utf-8", "ignore")) % (len(model.vectors) - 1) for g in grams]
        mean = model.vectors[ids].astype(float).mean(0) if ids else np.zeros(model.vectors.shape[1])
        z = np.exp(mean @ model.output + model.bias)
        assert r.score == pytest.approx(z[1] / z.sum(), abs=1e-4) and r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3)


def test_op9_scores_add_up_ratios(spark, documents):
    model, (_, got) = learned_on(spark, 3, 1, toxicity), rows_of(spark, "op9_toxicity")
    assert len(got) == len(documents)
    for r in got:
        grams = {g for w in (documents[r.doc_id].text or "").lower().split() for n in (4, 5) for g in (f" {w} "[a : a + n] for a in range(len(w) + 3 - n))}
        buckets = {xxhash.xxh32_intdigest(g.encode("utf-8", "ignore")) % len(model.weight) for g in grams}
        z = model.bias + sum(model.weight[b] for b in buckets)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -50, 50))), abs=1e-9) and r.held_out == (held(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7)


def test_op10_smallest_dictionary_wins(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, (_, got) = langid.fit(docs.where(crc_bucket(docs["doc_id"], 5) != 0)), rows_of(spark, "op10_language_id")
    packers = {name: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for name, d in model.dictionaries.items()}
    assert set(packers) == {r.lang for r in documents.values() if r.lang} and len(got) == len(documents)
    right = []
    for r in got:
        doc = documents[r.doc_id]
        assert r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        words = regex.findall(r"[^\W\d_]+", (doc.text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            assert r.lang_pred == "und"
            continue
        data = f" {' '.join(words)} ".encode()
        size = {name: sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for name, p in packers.items()}
        assert size[r.lang_pred] <= min(size.values()) + 2
        if r.held_out and doc.lang:
            right.append(r.lang_pred == doc.lang)
    assert np.mean(right) > 0.95


# --- the pipeline -----------------------------------------------------------------------------------------------------


@pytest.fixture
def corpus(spark, tmp_path):
    prose = texts(90, seed=7, words=70)
    rows = [(i, t if i % 3 else " ".join(w.upper() + "!!" for w in t.split()), "en", "abc"[i % 4 % 3]) for i, t in enumerate(prose)]
    rows += [(200 + i, prose[3 * i + 1] + (" tail" if i % 2 else ""), "en", "d") for i in range(12)]
    rows += [(300, "write to jane.roe@mail.example.org " + prose[1], "en", "a"), (301, None, None, None), (302, "", "en", "a"), (303, "x " * 9000 + prose[2], "en", "b")]
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(5000, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # columns whose names stages might use
    table(spark, rows).withColumnRenamed("_id", "n_entities").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_each_stage_of_the_pipeline(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs.collect(), stage(spark, docs, folder)
        if k == 4:
            break
        assert out.columns == columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = (before, docs.collect())
    before, after = kept["quality classifier"]
    ids = {r.doc_id for r in after}
    assert ids <= {r.doc_id for r in before} and len(after) == len(ids) and all((i in ids) == (i % 3 > 0) for i in range(90))
    assert {r.doc_id: r.text for r in after} == {r[0]: r[1] for r in rows if r[0] in ids}
    before, after = kept["MinHash near-dedup"]
    want = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(k for k, (_, c) in want.items() if k == c) and len(after) < len(before)
    before, after = kept["PII surrogates"]
    old, new = ({r.doc_id: r.text for r in x} for x in (before, after))
    assert set(old) == set(new) and all(new[k] == t for k, t in old.items() if "@" not in (t or ""))
    assert 300 not in new or "jane.roe" not in new[300] and re.match(r"write to [a-z]{4}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.org ", new[300])
    before, after = kept["mixing sources"]
    sizes, taken, largest = Counter(), Counter(), defaultdict(list)
    for r in before:
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
        largest[r.source].append(len(re.findall(WORD, r.text or "")))
    for r in after:
        taken[r.source] += len(re.findall(WORD, r.text or ""))
    goal = brute_targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= max(0.01 * goal[s], np.median(largest[s])) for s in sizes) and max(Counter(r.doc_id for r in after).values()) <= 2
    reader = Tokenizer.from_file(tokenizer_file())
    tokens = Counter()
    for r in out.collect():
        tokens[r.doc_id] += r.length
    want = Counter()
    for r in after:
        want[r.doc_id] += len(reader.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert tokens == want


def test_pipeline_runs_and_leaves_no_folder(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.count() > 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [x for x in os.listdir(os.path.dirname(folder)) + os.listdir(folder) if x.startswith("pipeline-")]


def test_pipeline_on_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
