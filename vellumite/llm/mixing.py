"""Mixing sources to target weights by pivotal dependent rounding.

A source's target words over its words is the number of copies its documents get, r. Each document has floor(r) copies
for certain and one more with probability r - floor(r). Those fractions are rounded by pivoting: a document and its partner
pass probability between each other, in words, until one's becomes 0 or 1, in a direction drawn so that each one's
expectation stays. The partner of a block's largest open document is the rest of the block together, which gives or takes
in proportion; so large documents settle first, against many smaller ones, and what stays open in the end is the
smallest. The words of the pair never change, so a source ends within one small document of its target.

Pairing runs as a reduction tree: documents are dealt by hash to blocks of about `fan_in`, each block folds its documents
into decisions and at most one document that is still fractional, and these go up to the next level's blocks, until a
source has one left, which is rounded to the nearer side. No block grows with the source; each level has fan_in times fewer rows.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, unit

#: A probability this near to 0 or 1 counts as there.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Pieces between runs of blanks, less the empty ones before a leading and after a trailing run."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    lead = (F.element_at(pieces, 1) == "").cast("int")
    trail = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - lead - trail).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size): a row for each source -> source, source_size, target.

    Sources in code point order, null last, weigh `weights`, repeating. share of all words is dealt out by weight; no
    target exceeds most times its source, and what is cut off is dealt out again among the others, which comes to one
    level t with targets min(most * size, t * weight): sources reach their limit in order of limit over weight, and t
    follows from how many have."""
    cap, by_ratio = F.col("source_size") * F.lit(float(most)), Window.orderBy("_ratio", "_rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % F.lit(len(weights)) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weigh).withColumn("_ratio", cap / F.col("_weight"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    # the first source, in order of ratio, that stays below its limit sets the level; from there on it only falls
    open_ = ranked.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(Window.partitionBy()))
    target = F.when(F.col("_level").isNull() | (F.col("_level") * F.col("_weight") >= cap), cap).otherwise(F.col("_level") * F.col("_weight"))
    return open_.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _fold(units: Column, seed: int, last: bool) -> Column:
    """Array of structs (id, size, p), largest first -> struct(open: the one still fractional or null, done: array of (id, extra)).

    Each unit pivots with the rest of the array, the partner: words go from the rest to it or back until it has 0 or 1, or
    the rest has nothing left to give or take. The rest's probabilities are a + b * p with a and b of the state, for units
    not yet met; words and mass are sums of size and of size * p over these. In the last fold of a source, where no other
    block can make up for it, a unit that the rest can settle one way only goes that way."""
    kind = "struct<a:double,b:double,words:double,mass:double,open:struct<id:bigint,size:bigint,p:double>,done:array<struct<id:bigint,extra:int>>>"
    none = F.array().cast("array<struct<id:bigint,extra:int>>")

    def step(state: Column, u: Column) -> Column:
        size = u["size"].cast("double")
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["a"] + state["b"] * u["p"]))
        words, mass = state["words"] - size, state["mass"] - size * u["p"]
        given = F.greatest(F.lit(0.0), state["a"] * words + state["b"] * mass)  # words the rest has to give
        room = F.greatest(F.lit(0.0), words - given)
        # an array's last unit has no partner
        up, down = F.least((1 - p) * size, given), F.least(p * size, room)
        rises = unit(u["id"], seed=seed) * (up + down) < down
        if last:
            settles = [(1 - p) * size <= given, p * size <= room]
            rises = F.when(settles[0] != settles[1], settles[0]).otherwise(rises)
        moved = F.when(up + down <= NEAR, 0.0).when(rises, up).otherwise(-down)
        now = p + moved / size
        less, more = F.when(given > 0, F.greatest(moved, F.lit(0.0)) / given).otherwise(0.0), F.when(room > 0, F.greatest(-moved, F.lit(0.0)) / room).otherwise(0.0)
        a = F.when(moved > 0, state["a"] * (1 - less)).otherwise(state["a"] + more * (1 - state["a"]))
        b = F.when(moved > 0, state["b"] * (1 - less)).otherwise(state["b"] * (1 - more))
        settled = (now < NEAR) | (now > 1 - NEAR)
        open_ = F.when(settled, state["open"]).otherwise(F.struct(u["id"].alias("id"), u["size"].alias("size"), now.alias("p")))
        done = F.concat(state["done"], F.when(settled, F.array(F.struct(u["id"].alias("id"), F.when(now > 0.5, 1).otherwise(0).cast("int").alias("extra")))).otherwise(none))
        return F.struct(a.alias("a"), b.alias("b"), words.alias("words"), mass.alias("mass"), open_.alias("open"), done.alias("done")).cast(kind)

    total = lambda f: F.aggregate(units, F.lit(0.0), lambda s, u: s + f(u))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), total(lambda u: u["size"].cast("double")).alias("words"), total(lambda u: u["size"] * u["p"]).alias("mass"), F.lit(None).cast("struct<id:bigint,size:bigint,p:double>").alias("open"), none.alias("done")).cast(kind)
    return F.aggregate(units, start, step)


def round_copies(units: DataFrame, fan_in: int = 256, seed: int = 1) -> DataFrame:
    """units (source, id long and distinct in its source, size long > 0, p double strictly between 0 and 1) -> source, id,
    extra (0 or 1)."""
    largest = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    if not largest:
        return units.select("source", "id", F.lit(0).alias("extra"))
    done, left, level = None, units, 0
    while largest > 0:
        blocks = max(1, -(-largest // fan_in))
        block = F.pmod(F.xxhash64("id", F.lit(seed * 1000 + level)), F.lit(blocks))
        grouped = left.groupBy("source", block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("size", "id", "p")), asc=False).alias("_units"))
        units_ = F.transform("_units", lambda u: F.struct(u["id"].alias("id"), u["size"].alias("size"), u["p"].alias("p")))
        folded = durable(grouped.withColumn("_units", units_).select("source", _fold(F.col("_units"), seed + level, blocks == 1).alias("_state")))
        settled = folded.select("source", F.explode("_state.done").alias("d")).select("source", "d.id", "d.extra")
        done = settled if done is None else done.unionByName(settled)
        left = folded.where("_state.open is not null").select("source", "_state.open.id", "_state.open.size", "_state.open.p")
        if blocks == 1:
            break
        largest, level = blocks, level + 1
    last = left.select("source", "id", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("extra"))
    return done.unionByName(last)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fan_in: int = 256, seed: int = 1) -> DataFrame:
    """Per row: key, source, size, source_size, target, copies, taken.

    Null and blank texts have size 0 and no copies beyond the floor of their source's ratio; they take no words. Rows that
    share key, source and size are decided together. An empty table gives an empty one. Reruns draw the same copies."""
    rows = durable(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    goal = durable(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most)).withColumnRenamed("source", "_source")
    known = rows.join(broadcast_if_small(goal), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = durable(known.withColumn("_base", F.floor(ratio + NEAR).cast("long")).withColumn("_p", ratio - F.col("_base")).withColumn("_id", F.xxhash64("_key", "source", "size")))
    fractional = known.where((F.col("size") > 0) & (F.col("_p") > NEAR) & (F.col("_p") < 1 - NEAR))
    units = fractional.groupBy(F.col("_id").alias("id"), "source", F.col("_p").alias("p")).agg(F.sum("size").alias("size"))
    extra = round_copies(units, fan_in, seed).select(F.col("source").alias("_source"), F.col("id").alias("_extra_id"), "extra")
    copies = F.col("_base") + F.coalesce(F.col("extra"), F.lit(0))
    out = known.join(extra, (F.col("_id") == F.col("_extra_id")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select(F.col("_key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as the mix takes it: absent, once or twice. Rows of one key are taken alike, as the
    one that is taken most."""
    taken = mix(docs, key=key, **options).groupBy(F.col(key).alias("_key")).agg(F.max("copies").cast("int").alias("_copies"))
    taken = durable(taken.where("_copies > 0"))
    joined = docs.join(broadcast_if_small(taken, 500_000), docs[key].eqNullSafe(taken["_key"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["_copies"])).alias("_copy")).select(*[docs[c] for c in docs.columns])
