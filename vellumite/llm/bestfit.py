"""Best-fit packing by hierarchical residual merging.

Documents are tokenized, each ended by one id; longer ones than a window are cut. Each partition packs its pieces block by
block, best fit by decreasing length, and gives away the bins that are nearly full. Bins with room left are items of their
fill for the next round: the blocks of a level are dealt to a tree's nodes, a node packs its children's bins by the same
rule, gives away what is nearly full, and hands the rest to the level above, up to one root.

Bins of equal fill are alike, so a node never needs to list them: it gets a count for each child and fill, at most
`window` of them, and answers with ranges ("of this child's bins of 900 tokens, numbers 40 to 79 go two by two into bins
17 to 36"). So a node's memory doesn't grow with the bins under it, whatever the lengths, and the root can be one task.
Only pieces of bins that were left with room at the lowest level are joined to the ranges; ids aren't shuffled otherwise.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable
from .packing import Encoder

#: A move: items `item`.. of one size, `per` of them to each of the bins `bin`.., behind the `before` tokens each holds.
Move = tuple[int, int, int, int, int, int]


def best_fit(counts: dict[int, int], window: int) -> tuple[list[Move], list[tuple[int, int, int]]]:
    """Best fit by decreasing size over counts of sizes 1..window.

    Returns moves (size, first item, items, items a bin, first bin, tokens before), items of a size numbered from 0, and
    the bins as (first, number, fill). Each item goes to the bin with the least room that takes it, so that a bin is
    filled with one size before the next bin of the same room: whole ranges of bins can be filled at once."""
    moves: list[Move] = []
    rooms: list[int] = []
    free: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def leave(room: int, first: int, n: int) -> None:
        if n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for size in sorted(counts, reverse=True):
        done, of = 0, counts[size]
        while done < of:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, n = window, made, -(-(of - done) // (window // size))
                made += n
            per = room // size
            full = min(n, (of - done) // per)
            if full:
                moves.append((size, done, full * per, per, first, window - room))
                leave(room - per * size, first, full)
                done += full * per
            rest = min(of - done, per) if full < n else 0
            if rest:
                moves.append((size, done, rest, rest, first + full, window - room))
                leave(room - rest * size, first + full, 1)
                done += rest
            leave(room, first + full + bool(rest), n - full - bool(rest))
    return moves, sorted((first, n, window - room) for room, ranges in free.items() for first, n in ranges)


def ranked(bins: list[tuple[int, int, int]], window: int, slack: int, last: bool) -> list[tuple[int, int, int, int]]:
    """bins as (first, number, fill, rank of the first among the bins of its fill; -1 for bins that are given away)."""
    seen: dict[int, int] = {}
    out = []
    for first, n, fill in bins:
        if last or fill >= window - slack:
            out.append((first, n, fill, -1))
        else:
            out.append((first, n, fill, seen.get(fill, 0)))
            seen[fill] = seen.get(fill, 0) + n
    return out


def tokenize(docs: DataFrame, key: str, text: str, tokenizer_file: str, end_id: int, window: int, slack: int, block: int, block_bytes: int) -> DataFrame:
    """A row for each piece: _id, _piece, _start, _n, _ids, and where its block packs it: _node (the block), _bin, _at,
    _fill (the bin's), _rank (the bin's, among those of its block and fill that have room; -1 without room)."""
    schema = "_id long, _piece int, _start long, _n long, _ids binary, _node long, _bin long, _at long, _fill long, _rank long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, node = Encoder(tokenizer_file), TaskContext.get().partitionId() << 20
        end, size = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        waiting: list[tuple] = []

        def packed() -> pa.RecordBatch:
            sizes = np.array([w[3] for w in waiting])
            moves, bins = best_fit(dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True)), window)
            order = np.argsort(-sizes, kind="stable")
            # moves of a size follow its items' numbers, sizes decrease: together they name the items in this order
            into = np.concatenate([first + np.arange(n) // per for _, _, n, per, first, _ in moves])
            at = np.concatenate([before + np.arange(n) % per * s for s, _, n, per, _, before in moves])
            total = sum(n for _, n, _ in bins)
            fill, rank = np.zeros(total, np.int64), np.full(total, -1, np.int64)
            for first, n, f, r in ranked(bins, window, slack, False):
                fill[first : first + n] = f
                if r >= 0:
                    rank[first : first + n] = r + np.arange(n)
            ident, piece, start, n, data = zip(*(waiting[i] for i in order), strict=True)
            long = [pa.array(x, pa.int64()) for x in (np.full(len(into), node), into, at, fill[into], rank[into])]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), *long], names=names)

        held = 0
        for batch in batches:
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode([t.as_py() or ""])[0] + end
                n = len(data) // size
                cuts = [0, *range(n % window or window, n, window), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    waiting.append((ident, piece, a, b - a, data[size * a : size * b]))
                    held += size * (b - a)
                    if len(waiting) >= block or held >= block_bytes:
                        yield packed()
                        node, held = node + 1, 0
        if waiting:
            yield packed()

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


#: What a node says of its children's bins: number `_from` up to `_to` of fill _size at child _node are items of parent
#: _up; item j goes to the parent's bin _bin + (j + _shift) // _per, behind _before tokens; that bin's _fill and _rank.
RANGES = "_node long, _size long, _from long, _to long, _shift long, _per long, _before long, _up long, _bin long, _fill long, _rank long"


def merged(open_bins: DataFrame, nodes: int, window: int, slack: int) -> DataFrame:
    """RANGES for counts of bins with room (_node, _size, _count), the children dealt to `nodes` parents."""
    names = [c.split()[0] for c in RANGES.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("_size", "_node", "_count")), strict=True))
        up = table.column("_up")[0].as_py()
        counts: dict[int, int] = {}
        base = {}
        for size, child, n in rows:
            base[size, child] = counts.get(size, 0)
            counts[size] = counts.get(size, 0) + n
        moves, bins = best_fit(counts, window)
        bins = ranked(bins, window, slack, nodes == 1)
        firsts = [b[0] for b in bins]
        of_size: dict[int, list] = {}
        for size, item, n, per, bin_, before in moves:
            k = bisect_left(firsts, bin_ + 1) - 1
            while k < len(bins) and bins[k][0] < bin_ + -(-n // per):
                first, some, fill, rank = bins[k]
                lo = max(first, bin_)
                a, b = item + (lo - bin_) * per, min(item + n, item + (first + some - bin_) * per)
                of_size.setdefault(size, []).append((a, b, per, before, lo, fill, rank if rank < 0 else rank + lo - first))
                k += 1
        out = []
        for size, child, n in rows:
            begin = base[size, child]
            for a, b, per, before, bin_, fill, rank in of_size[size]:
                lo, hi = max(a, begin), min(b, begin + n)
                if lo < hi:
                    out.append((child, size, lo - begin, hi - begin, begin - a, per, before, up, bin_, fill, rank))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return open_bins.withColumn("_up", F.pmod(F.xxhash64("_node"), F.lit(nodes))).groupBy("_up").applyInArrow(run, RANGES)


def climbed(bins: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    """bins (_node, _size, _rank; _at so far) one level up; those that find no room above any more get a _sequence."""
    at = F.col("_rank") + F.col("_shift")
    known = broadcast_if_small(ranges.withColumnsRenamed({"_node": "_n", "_size": "_s", "_rank": "_r"}))
    found = bins.join(known, (F.col("_node") == F.col("_n")) & (F.col("_size") == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    into = F.floor(at / F.col("_per")).cast("long")
    offset = F.col("_at") + F.col("_before") + at % F.col("_per") * F.col("_size")
    closed = F.lit(level).cast("long") * F.lit(1 << 60) + F.col("_up") * F.lit(1 << 40) + F.col("_bin") + into
    return found.select(
        "_node0", "_fill0", "_rank0", F.col("_up").alias("_node"), F.col("_fill").alias("_size"), F.when(F.col("_r") >= 0, F.col("_r") + into).otherwise(-1).alias("_rank"),
        offset.alias("_at"), F.when(F.col("_r") < 0, closed).alias("_sequence"),
    )


def pack(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 0, slack: int = 2, fan: int = 16, block: int = 65_536, block_bytes: int = 32 << 20) -> DataFrame:
    """Per piece: key, piece (from 0), start, length, ids (binary: unsigned little-endian 32-bit), sequence_id, offset.

    Documents of more than `window` ids are cut; the first piece takes what is over, so that all others are full. A bin
    within `slack` tokens of full is given away. A block is at most `block` pieces or block_bytes of ids; a node of the
    tree has about `fan` children. Null and empty texts are documents of end_id alone. Repeated and null keys are packed
    as often as they occur. Sequence numbers have gaps."""
    if window < 1 or fan < 2 or block > 1 << 20:
        raise ValueError("window must be above 0, fan above 1, block at most 2**20")
    tokens = durable(tokenize(docs, key, text, tokenizer_file, end_id, window, slack, block, block_bytes))
    # of a bin, the piece at its beginning stands for it
    rooms = durable(tokens.where((F.col("_rank") >= 0) & (F.col("_at") == 0)).select("_node", F.col("_fill").alias("_size"), "_rank"))
    level, counts = 0, rooms.groupBy("_node", "_size").agg(F.count("*").alias("_count"))
    nodes = rooms.select("_node").distinct().count()
    # with one block only, what has room there stays as it is
    places = rooms.select(F.col("_node").alias("_node0"), F.col("_size").alias("_fill0"), F.col("_rank").alias("_rank0"), "_node", "_size", "_rank", F.lit(0).cast("long").alias("_at"))
    done = None
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // fan)
        ranges = durable(merged(counts, nodes, window, slack))
        moved = climbed(places, ranges, level)
        if nodes > 1:
            moved = durable(moved)
        closed, places = moved.where("_sequence IS NOT NULL"), moved.where("_sequence IS NULL").drop("_sequence")
        done = closed if done is None else done.unionByName(closed)
        counts = places.where("_at = 0").groupBy("_node", "_size").agg(F.count("*").alias("_count"))

    own = F.col("_node") * F.lit(1 << 20) + F.col("_bin")
    if done is None:
        placed = tokens.withColumn("_sequence", own).withColumn("_offset", F.col("_at"))
    else:
        shut = tokens.where("_rank < 0").withColumn("_sequence", own).withColumn("_offset", F.col("_at"))
        found = done.select("_node0", "_fill0", "_rank0", F.col("_at").alias("_ahead"), "_sequence")
        still = tokens.where("_rank >= 0").join(found, (F.col("_node") == F.col("_node0")) & (F.col("_fill") == F.col("_fill0")) & (F.col("_rank") == F.col("_rank0")))
        placed = shut.unionByName(still.withColumn("_offset", F.col("_ahead") + F.col("_at")).select(*shut.columns))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4").astype("<u4").tobytes() for d, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    out = placed.select(F.col("_id"), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_n").alias("length"), F.col("_ids").alias("ids"), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))
    return out.mapInArrow(wide, out.schema).withColumnRenamed("_id", key)
