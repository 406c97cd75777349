"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has a preference order of the slots of a prime-sized table: offset + i * skip modulo the size, both from the MD5 of
its name. Shards take turns (``weight`` of them a round), each claiming its next free slot, until the table is full; so slots
split evenly, and adding or losing a shard moves few. The table's size is fixed by the number of shards, never by the data; it
goes to the executors as a constant array and places a key in constant time: key hash modulo size, then one array access.

Empty table: no rows. Very long keys are hashed whole. A null key has slot and shard of the empty key. Repeated keys share a shard. Other columns are kept; clashing ones named slot
or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime over 100 times the number of shards that production uses, which keeps shares within 1 %.
TABLE_SIZE, SHARDS = 7001, 64


def preference(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(names: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """Number of the shard that holds each slot."""
    if not names or len(names) > size or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("a table needs a prime size and at least one, at most size, shards")
    if weights is not None and (len(weights) != len(names) or min(weights) < 0 or not any(weights)):
        raise ValueError("every shard needs a weight of 0 or more, and one of them more than 0")
    prefer = [preference(n, size) for n in names]
    place, table, free = [0] * len(names), [-1] * size, size
    while free:
        for shard, (offset, skip) in enumerate(prefer):
            for _ in range((weights or [1] * len(names))[shard]):
                if not free:
                    return table
                while table[slot := (offset + place[shard] * skip) % size] >= 0:
                    place[shard] += 1
                table[slot] = shard
                free -= 1
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, table: list[int]) -> DataFrame:
    """The rows with slot and shard."""
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return rows.withColumn("slot", slot(F.col(key), len(table))).withColumn("shard", F.get(constant, F.col("slot")))


def write_shards(rows: DataFrame, key: str, table: list[int], path: str) -> None:
    """A folder of Parquet files for each shard; a shard's rows are dealt over as many tasks as they come from."""
    place(rows, key, table).write.partitionBy("shard").parquet(path)
