"""Sharding with a permutation-filled lookup table (Maglev hashing)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more slots than this isn't broadcast as a matter of course.
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The shard number of each slot: shards take turns, each claiming the next free slot it prefers.

    A shard prefers slots offset, offset + skip, offset + 2 skip, ... modulo the prime number of slots, so
    that its preferences are a permutation of all slots. Both numbers come from the md5 of its name.
    """
    if not shards or len(set(shards)) < len(shards) or not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"distinct shards and a prime number of slots from their count to {MOST_SLOTS} are needed")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    return claim([int(d[:8], 16) % slots for d in digests], [int(d[8:16], 16) % (slots - 1) + 1 for d in digests], slots)


def claim(offsets: list[int], skips: list[int], slots: int) -> list[int]:
    """The number of the shard that claims each slot, one turn after the other."""
    at, table, free = list(offsets), [-1] * slots, slots
    while free:
        for shard, skip in enumerate(skips):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard): one row a slot, at most MOST_SLOTS."""
    numbers = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    return spark.range(slots).select(F.col("id").alias("slot"), F.get(names, F.get(numbers, F.col("id").cast("int")).cast("int")).alias("shard"))


def slot_of(key, slots: int) -> F.Column:
    """The slot of a key: the first 32 bits of its md5, modulo the number of slots."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots


def shard(docs: DataFrame, shards: list[str], slots: int = 65537, key_col: str = "doc_id") -> DataFrame:
    """All columns of docs with their slot and shard (columns `slot` and `shard`, which replace any of those names).

    Placement depends on the key alone: equal keys go together, a null key to the slot of the empty text, and
    when a shard leaves, few keys of the others move. The lookup table has a bounded number of rows and is
    broadcast; rows are not shuffled, so a frequent key or source makes no task larger. An empty table gives
    an empty result.
    """
    placed = docs.drop("shard").withColumn("slot", slot_of(F.col(key_col), slots))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot")
