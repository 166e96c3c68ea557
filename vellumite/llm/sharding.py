"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size: it starts at an offset and goes on by a step,
both taken from the md5 of its name. The shards take turns; at its turn a shard claims the first slot of its permutation
that is still free (a shard of weight w claims w slots in its turn), until no slot is free. A key's slot is a hash of the
key modulo the table's size, so that placing a key is one lookup, shards get almost equal numbers of slots, and adding or
removing a shard moves few of the other shards' slots.

The table has `slots` rows, whatever the data's size; it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> list[int]:
    """The owner (a position in shards) of every slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    place = [_number(f"{s}/offset") % slots for s in shards]
    step = [_number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                if not left:
                    return owner
                while owner[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % slots
                owner[place[i]] = i
                left -= 1
    return owner


def key_hash(key: Column) -> Column:
    """The first 32 bits of the md5 of the key's text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def lookup_table(spark, shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> DataFrame:
    """slot long, shard_id int, shard string."""
    owners = ",".join(map(str, fill(shards, slots, weights)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("int").alias("shard_id"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def assign(df: DataFrame, key: str, shards: Sequence[str], slots: int = 65537, weights: Sequence[int] | None = None) -> DataFrame:
    """df with slot, shard_id and shard; columns of these names are replaced. Equal keys always meet in one shard."""
    placed = df.drop("slot", "shard_id", "shard").withColumn("slot", key_hash(F.col(key)) % F.lit(slots))
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots, weights)), "slot", "left").select(*[c for c in placed.columns if c != "slot"], "slot", "shard_id", "shard")
