"""MinHash near-duplicates: b-bit signatures, banded candidates, exact confirmation.

1. A text's set is its distinct shingles of `width` words, hashed to 64 bits. Texts with equal sets become one class (its
   fingerprint is a 128-bit hash of the sorted set); everything below is between classes.
2. Each class gets `bands * rows` minima. Bands of `rows` minima give candidate groups; of every minimum the low `bits`
   bits are kept and packed, and the bits that agree between two packed signatures estimate their similarity, corrected
   for the 2**-bits chance that different minima agree.
3. In each group every member is paired with the group's smallest class only. Pairs with a high enough estimate and
   near enough set sizes are confirmed on the full sets, and confirmed links are joined to components.
4. Groups whose members are then in different components are gone through once more: members outside the component of
   the group's smallest class (strays) meet the others of the group, in blocks. What is compared are parity sketches: each
   shingle flips one bit of a row of bits, so that two sketches never differ in more bits than their sets in shingles, and
   a pair that differs in more bits than similarity 0.8 allows is ruled out for certain. Of the pairs that remain only
   those come out that join parts still apart, fewer than a block has members; they are confirmed on the full sets.
5. Where one of these is refuted, its groups are gone through again with the full sets at hand.

No pair of one component is compared again, and no link between components stays untested.

Sets, signatures, links and components stay in distributed tables; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, driver_gives_back, durable, lean

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words(dict):
    """Word -> 64-bit hash; forgets at `limit` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words than width, the whole sequence is one; none without words.

    A to Z are lower-cased; words end at blanks (space, tab, line feed, vertical tab, form feed, carriage return)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(known) > known.limit:
        known.clear()
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = _mixed(out + h[k : k + n] * _ODD[k % len(_ODD)])
    return np.unique(out)


class Signer:
    """Minima of bands * rows permutations of 32-bit hashes, in blocks that fit the processor's cache."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows, self.bits, self.k = bands, rows, bits, k
        self.a = (rng.integers(0, 1 << 31, k, np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 512):
            part = self.a[:, None] * low[None, i : i + 512] + self.b[:, None]
            np.minimum(least, part.min(1), out=least)
        return least

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (int64) and packed low bits (int64)."""
        least = self.minima(hashes).astype(np.uint64)
        bands = np.zeros(self.bands, np.uint64) + np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            bands = _mixed(bands + least[r :: self.rows] * _ODD[0] + np.uint64(r))
        low = _mixed(least + _ODD[1]) & np.uint64((1 << self.bits) - 1)
        per = 64 // self.bits
        packed = np.zeros(-(-self.k // per), np.uint64)
        for i in range(per):
            part = low[i::per]
            packed[: len(part)] |= part << np.uint64(i * self.bits)
        return bands.view(np.int64), packed.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """_id, n_shingles, _fp (16 bytes), _bands, _packed; the last three are null for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = Words(), Signer(bands, rows, bits)
        schema = pa.schema([("_id", pa.int64()), ("n_shingles", pa.int64()), ("_fp", pa.binary()), ("_bands", pa.list_(pa.int64())), ("_packed", pa.list_(pa.int64()))])
        for batch in batches:
            rows_ = []
            for text_ in batch.column(1).to_pylist():
                hashes = shingles(text_, width, known)
                rows_.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), *signer.sign(hashes)) if len(hashes) else (0, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array([r[i] for r in rows_], schema.field(i + 1).type) for i in range(4)]], schema=schema)

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(lambda b: lean(sign(b)), "_id long, n_shingles long, _fp binary, _bands array<long>, _packed array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_id, _set (sorted distinct hashes)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            values = [shingles(t, width, known).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["_id", "_set"])

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(lambda b: lean(sets(b)), "_id long, _set array<long>")


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bits flipped once for each hash; their number is the power of two in 4 to 8 times the set's size, 256 at least."""
    m = 1 << max(8, int(4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """node, n, _sketch of the documents named by ids (_id)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            sets = [shingles(t, width, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_sketch(x) for x in sets], pa.binary())], names=["node", "n", "_sketch"])

    named = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(broadcast_if_small(ids, 500_000), "_id", "left_semi")
    return named.mapInArrow(lambda b: lean(sketch(b)), "node long, n long, _sketch binary").where("n > 0").dropDuplicates(["node"])


def estimate(a: Column, b: Column, k: int, bits: int) -> Column:
    """Similarity of two packed signatures: the share of minima whose kept bits all agree, corrected for chance."""
    repeated = sum(1 << (i * bits) for i in range(64 // bits))  # the lowest bit of every field
    repeated -= (1 << 64) if repeated >= 1 << 63 else 0

    def differing(x: Column) -> Column:
        folded = x
        for i in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(F.lit(repeated)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    return ((1 - unlike / F.lit(float(k))) - chance) / (1 - chance)


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a whole graph -> node, root: labels fall along links and jump to their labels' labels."""
    tables = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not tables:
        return
    u, v = (np.concatenate(x) for x in zip(*tables, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    left, right, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, now = np.minimum(label[left], label[right]), label.copy()
        # the larger label itself falls as well, so that whatever carries it follows
        for x in (left, right, label[left], label[right]):
            np.minimum.at(now, x, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            break
        label = now
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, together: int = 1_000_000) -> DataFrame:
    """links (a, b) -> node, root: the smallest node that can be reached. Nodes without links are absent.

    At most `together` links are joined in one task, which spares a dozen small jobs. More of them alternate large-star and
    small-star steps until the links no longer change; each writes a table of at most as many links as there were, and
    minima are pre-aggregated, so that a node with very many links is no burden. The answer is the same. links is read
    twice; it had better be written already."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if now.limit(together + 1).count() <= together:
        return durable(now.repartition(1).mapInArrow(lambda b: lean(_joined(b)), "node long, root long"))
    now = durable(now.distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = durable(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets have percent * union <= 100 * intersection. Sets are made anew of the texts named."""
    named = durable(pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct())
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(broadcast_if_small(named, 500_000), "_id", "left_semi")
    sets = durable(shingle_sets(texts, "_id", "_text", width).dropDuplicates(["_id"]))
    left = pairs.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a")
    both = left.join(sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(F.lit(100) * common >= F.lit(percent) * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, bands: int = 32, rows: int = 4, bits: int = 4, slack: float = 0.18, block: int = 512, hot: int = 100_000) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept (the row's key is its component's).

    Null, empty and blank texts have no shingles and no links: each is its own component. Rows of a repeated key are one
    document: what any of its texts is linked with is in its component; all of its rows are returned, each with the size of
    its own set. Where a key has several texts, distinct pairs of key and text are written once and compared by numbers of
    their own. Keys are integers; rows of a null key are linked with nothing and kept.
    At similarity 0.8 a pair shares no band with probability (1 - 0.8**rows)**bands, 5e-8 by default; slack is how far
    below the threshold an estimate may lie before a pair is left unconfirmed, about 5 standard errors by default. Classes
    of more than `hot` equal texts are looked up by a broadcast, so that their rows stay where they are."""
    signed = durable(signatures(docs, key, text, width, bands, rows, bits))
    own = F.xxhash64("_fp")
    if not signed.where("_id is not null").groupBy("_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").isEmpty():
        return _tied(docs, key, text, width=width, percent=percent, bands=bands, rows=rows, bits=bits, slack=slack, block=block, hot=hot)
    worded = signed.where("_fp is not null and _id is not null")
    # classes of equal sets; node: the smallest key of the class
    classes = durable(worded.groupBy("_fp").agg(F.min("_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("_packed").alias("_packed"), F.first("_bands").alias("_bands")))
    nodes = classes.select("node", "n", "_packed")
    banded = classes.select("node", F.posexplode("_bands").alias("_band", "_hash")).select("node", F.xxhash64("_band", "_hash").alias("group"))
    least = banded.groupBy("group").agg(F.min("node").alias("rep"), F.count("*").alias("members")).where("members > 1")
    groups = durable(banded.join(least, "group"))
    driver_gives_back(docs.sparkSession)
    threshold = percent / 100 - slack

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that estimates and sizes don't rule out."""
        x = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("_packed").alias("pa")), "a")
        x = x.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("_packed").alias("pb")), "b")
        return x.where(similar_sizes(F.col("na"), F.col("nb"), percent) & (estimate(F.col("pa"), F.col("pb"), bands * rows, bits) >= threshold)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return durable(confirm(pairs, docs, key, text, width, percent))

    def mixed(found: DataFrame, among: DataFrame) -> DataFrame:
        """The groups that hold more than one component: group, node, members, root, stray."""
        of = among.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("group", "node", "rep", "members", F.coalesce("root", "node").alias("root"))
        several = of.groupBy("group").agg(F.max(F.when(F.col("node") == F.col("rep"), F.col("root"))).alias("rep_root"), F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most")
        return of.join(several, "group").select("group", "node", "members", "root", (F.col("root") != F.col("rep_root")).alias("stray"))

    links = confirmed(durable(likely(groups.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct())))
    found = components(links)
    driver_gives_back(docs.sparkSession)
    placed = durable(mixed(found, groups))
    named = durable(placed.select(F.col("node").alias("_id")).distinct())
    if not named.isEmpty():
        sketched = durable(sketches(docs, named, key, text, width))
        tried = durable(joining_pairs(placed, sketched, percent, block).distinct())
        n_tried = tried.count()
        sure = confirmed(tried) if n_tried else tried
        n_sure = sure.count() if n_tried else 0
        if n_sure:
            links = links.unionByName(sure)
            found = components(links)
        if n_sure < n_tried:
            refuted = tried.join(sure, ["a", "b"], "left_anti")
            sides = placed.select("group", "node")
            doubtful = refuted.join(sides.withColumnRenamed("node", "a"), "a").join(sides.withColumnRenamed("node", "b"), ["b", "group"]).select("group").distinct()
            again = durable(mixed(found, groups.join(durable(doubtful), "group", "left_semi")))
            texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(broadcast_if_small(durable(again.select(F.col("node").alias("_id")).distinct()), 500_000), "_id", "left_semi")
            sets = durable(shingle_sets(texts, "_id", "_text", width).dropDuplicates(["_id"])).withColumnRenamed("_id", "node")
            more = durable(joining_pairs(again, sketched.join(sets, "node"), percent, block).distinct())
            if not more.isEmpty():
                found = components(links.unionByName(more))
        driver_gives_back(docs.sparkSession)
    roots = classes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("_fp", "copies", F.coalesce("root", "node").alias("_root"))
    rest, out = worded.select("_id", "n_shingles", "_fp"), []
    if not classes.where(F.col("copies") > hot).isEmpty():
        large = durable(roots.where(F.col("copies") > hot).select(F.col("_fp").alias("_f"), F.col("_root").alias("_large")))
        known = rest.join(broadcast_if_small(large), F.col("_fp") == F.col("_f"), "left")
        out = [known.where("_f is not null").select("_id", "n_shingles", F.col("_large").alias("_root"))]
        rest = known.where("_f is null").select("_id", "n_shingles", "_fp")
    out.append(rest.join(roots.where(F.col("copies") <= hot).drop("copies"), "_fp").select("_id", "n_shingles", "_root"))
    # texts without words, and rows of a null key
    out.append(signed.where("_fp is null or _id is null").select("_id", "n_shingles", F.col("_id").alias("_root")))
    whole = reduce(DataFrame.unionByName, out)
    return whole.select(F.col("_id").alias(key), "n_shingles", F.col("_root").alias("component_id"), F.col("_id").eqNullSafe(F.col("_root")).alias("kept"))


def _tied(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """near_duplicates of documents some of whose keys have several texts: each pair of key and text is a document of its
    own first; then the components that a key's texts lie in become one."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    pairs = durable(rows.groupBy("_key", "_text").agg(F.count("*").alias("_copies")).withColumn("_node", F.monotonically_increasing_id()))
    found = near_duplicates(pairs, "_node", "_text", **options).select("_node", "n_shingles", F.col("component_id").alias("_part"))
    placed = durable(pairs.select("_node", "_key", "_copies").join(found, "_node"))
    known = placed.where("_key is not null")
    first = known.groupBy("_key").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).where("a <> b").select(F.col("_key").alias("_k"), "a")
    joined = components(durable(known.join(first, F.col("_key") == F.col("_k")).select("a", F.col("_part").alias("b")).distinct()))
    whole = placed.join(joined.withColumnRenamed("node", "_n"), F.col("_part") == F.col("_n"), "left").withColumn("_root", F.coalesce("root", "_part"))
    least = whole.groupBy(F.col("_root").alias("_r")).agg(F.min("_key").alias("component_id"))
    out = whole.join(least, F.col("_root") == F.col("_r")).withColumn("component_id", F.when(F.col("_key").isNotNull(), F.col("component_id")))
    each = out.select(F.col("_key").alias(key), "n_shingles", "component_id", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def spanning(sketch: list[bytes], n: np.ndarray, root: np.ndarray, node: np.ndarray, own: np.ndarray, stray: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of a stray and an own member that join parts (values of root) still apart, each stray's likeliest first.

    The pairs are those that sizes and sketches don't rule out; with sets, those that are similar in fact. Sketches of
    twice the length are folded, which leaves the bounds as they are."""
    now, width, found = root.copy(), np.array([len(x) // 8 for x in sketch]), []
    rows = {w: np.frombuffer(b"".join(x for x, k in zip(sketch, width, strict=True) if k == w), np.uint64).reshape(-1, w) for w in np.unique(width).tolist()}
    place = np.empty(len(width), np.int64)
    mine, tables = {}, {}
    for w, table in rows.items():
        of = np.flatnonzero(width == w)
        place[of] = np.arange(len(of))
        at = of[own[of]]
        if len(at):
            mine[w], tables[w] = at, table[place[at]]
    fold = {w: t[:, : w // 2] ^ t[:, w // 2 :] for w, t in tables.items() if w > 4}
    for s in np.flatnonzero(stray).tolist():
        w = int(width[s])
        x = rows[w][place[s]]
        hits, apart = [], []
        for at, table, y in ((mine.get(w), tables.get(w), x), (mine.get(2 * w), fold.get(2 * w), x), (mine.get(w // 2), tables.get(w // 2), x[: w // 2] ^ x[w // 2 :])):
            if at is None or table is None:
                continue
            free = now[at] != now[s]
            if not free.any():
                continue
            to = at[free]
            unlike = np.bitwise_count(table[free] ^ y).sum(1, dtype=np.int64)
            both = n[to] + n[s]
            ok = ((100 + percent) * unlike <= (100 - percent) * both) & (np.minimum(n[to], n[s]) * 100 >= np.maximum(n[to], n[s]) * percent)
            hits.append(to[ok])
            apart.append(unlike[ok] / both[ok])
        left = np.concatenate(hits) if hits else np.empty(0, np.int64)
        if not len(left):
            continue
        left = left[np.lexsort((node[left], np.concatenate(apart)))]
        while len(left):
            h, left = left[0], left[1:]
            if sets is not None:
                common = len(np.intersect1d(sets[s], sets[h], assume_unique=True))
                if 100 * common < percent * (len(sets[s]) + len(sets[h]) - common):
                    continue
            found.append((int(min(node[s], node[h])), int(max(node[s], node[h]))))
            now[now == now[h]] = now[s]
            left = left[now[left] != now[s]]
    return found


def joining_pairs(placed: DataFrame, known: DataFrame, percent: int, block: int, per_task: int = 5_000) -> DataFrame:
    """Pairs (a, b) by `spanning` of each block of the groups; known has each node's sketch, and may have the column _set.

    A group is dealt to blocks of about `block` members; strays go to every block of their group as well. Blocks are many
    and mostly tiny, so that they go in batches of about per_task rows."""
    exact = "_set" in known.columns

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "_block", "node"], kind="stable")
        sketch, sets = pdf["_sketch"].tolist(), [np.asarray(x) for x in pdf["_set"]] if exact else None
        n, root, node, group, part, own, stray = (pdf[c].to_numpy() for c in ("n", "root", "node", "group", "_block", "own", "stray"))
        ends = np.flatnonzero(np.concatenate(((group[1:] != group[:-1]) | (part[1:] != part[:-1]), [True]))) + 1
        out, start = [], 0
        for end in ends.tolist():
            at = slice(start, end)
            out += spanning(sketch[at], n[at], root[at], node[at], own[at], stray[at], percent, sets[at] if exact else None)
            start = end
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64").drop_duplicates()

    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    home = F.pmod(F.xxhash64("node"), blocks).cast("int")
    kept = ["group", "node", "n", "root", "stray", "_sketch", *(["_set"] if exact else [])]
    rows = placed.join(known, "node").select(*kept, home.alias("_home"), F.explode(F.when(F.col("stray"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(home))).alias("_block"))
    rows = rows.withColumn("own", F.col("_home") == F.col("_block")).drop("_home")
    copies = placed.agg(F.sum(F.when(F.col("stray"), blocks).otherwise(1))).first()[0] or 0  # the rows' number
    batches = max(1, -(-copies // per_task))
    return rows.groupBy(F.pmod(F.xxhash64("group", "_block"), F.lit(batches)).alias("_batch")).applyInPandas(compare, "a long, b long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest key, and of a repeated key the row of the
    smallest text, null first."""
    kept = durable(near_duplicates(docs, key, text, **options).where("kept").select(F.col(key).alias("_kept")).distinct())
    driver_gives_back(docs.sparkSession)
    left = docs.join(broadcast_if_small(kept, 500_000), docs[key].eqNullSafe(kept["_kept"]), "left_semi")
    known = docs.where(docs[key].isNotNull())
    if known.groupBy(key).count().where("count > 1").isEmpty():
        return left
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first(), F.xxhash64(*docs.columns)))
    name = "_place"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return left.where(F.col(key).isNotNull()).withColumn(name, place).where(F.col(name) == 1).drop(name).unionByName(left.where(F.col(key).isNull()))
