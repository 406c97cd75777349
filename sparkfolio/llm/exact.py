"""Exact dedup by a minimal perfect hash over historical distinct digests.

Texts are equal when identical without the characters 20 and 09-0D (hex); the digest is the SHA-256 of that. History's distinct
digests are dealt by their first bytes over shards, and each shard holds a minimal perfect hash in levels: a level maps every
digest left to a bit of its array, digests alone on their bit stay and the others go on to the next level; a digest's slot is
the rank of its bit. Slots hold full digests and winner locators (doc_id, code points, copies). A new digest is looked up in
constant time and compared byte by byte with the slot: members join the historical winner's group (and replace it if longer),
nonmembers were grouped by digest separately and win their own group. New rows meet the shards pre-aggregated, one row for
each digest and task at most, so copies in any number load no shard.

Of a group the row with the most code points stays, then the smallest doc_id (null last). Null texts count as empty, empty texts
are equal. Of rows that repeat doc_id and text, exactly one has kept = true. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U, bounded, mix, partitions, shared

#: Digests for each shard, about; and shards at least for each shuffle partition.
SHARD_ROWS, SPREAD = 100_000, 4
#: Bits of a level's array for each digest that is left.
LOAD = 2
SLOTS = "shard int, levels array<binary>, digests binary, ids binary, lengths binary, counts binary"
NONE = np.iinfo(np.int64).max  # orders a null doc_id last


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), length (code points) of every row."""

    def run(batches):
        for batch in batches:
            raw, sizes = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                raw.append(hashlib.sha256(text.encode("utf-8").translate(None, SPACE)).digest())
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "digest", "length"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, length long")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, length and id of the winner, n: one row for each digest, combined before the shuffle."""
    best = F.min(F.struct(F.negate("length").alias("less"), F.coalesce("doc_id", F.lit(int(NONE))).alias("id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).select("digest", (-F.col("best.less")).alias("length"), F.col("best.id").alias("id"), "n")


def halves(raw: list[bytes] | np.ndarray) -> np.ndarray:
    """The digests as rows of four 64-bit numbers."""
    return np.frombuffer(b"".join(raw) if not isinstance(raw, np.ndarray) else raw.tobytes(), U).reshape(-1, 4)


def spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys[:, 0] ^ mix(keys[:, 1] + U(level))) % U(bits)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bit arrays over distinct digests, and each digest's slot."""
    levels, slots, base, left = [], np.zeros(len(keys), np.int64), 0, np.arange(len(keys))
    while len(left):
        bits = max(64, LOAD * len(left))
        at = spot(keys[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        stay = alone[at]
        slots[left[stay]] = base + np.cumsum(alone)[at[stay]] - 1
        base += int(alone.sum())
        levels.append(alone)
        left = left[~stay]
    return levels, slots


def look_up(levels: list[np.ndarray], table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 if the bytes in the slot differ or no level holds its bit."""
    out, base, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = spot(keys[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    known = out >= 0
    known[known] = (table[out[known]] == keys[known]).all(1)
    return np.where(known, out, -1)


def sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", (F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long") % shards).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over the rows of ``grouped``: a row for each shard."""

    def run(key, rows):
        keys = halves(rows["digest"].to_pylist())
        levels, slots = build(keys)
        order = np.argsort(slots)
        held = [np.asarray(rows[c])[order].tobytes() for c in ("id", "length", "n")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([[np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in levels]], pa.list_(pa.binary())), pa.array([keys[order].tobytes()], pa.binary()), *(pa.array([x], pa.binary()) for x in held)], ["shard", "levels", "digests", "ids", "lengths", "counts"])

    return sharded(history, shards).groupBy("shard").applyInArrow(run, SLOTS)


def resolve(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, group_size of every digest of history and of the new rows (both as ``grouped``), and whether history knew it."""

    def run(key, rows, held):
        keys = halves(rows["digest"].to_pylist())
        ids, lengths, n = (np.asarray(rows[c]).copy() for c in ("id", "length", "n"))
        known = np.zeros(len(keys), bool)
        if held.num_rows:
            one = {c: held[c][0].as_py() for c in held.column_names}
            levels = [np.unpackbits(np.frombuffer(x[:-8], np.uint8))[: int.from_bytes(x[-8:], "little")].astype(bool) for x in one["levels"]]
            table = np.frombuffer(one["digests"], U).reshape(-1, 4)
            old_ids, old_lengths, old_n = (np.frombuffer(one[c], np.int64).copy() for c in ("ids", "lengths", "counts"))
            slot = look_up(levels, table, keys)
            known = slot >= 0
            at = slot[known]
            better = (lengths[known] > old_lengths[at]) | ((lengths[known] == old_lengths[at]) & (ids[known] < old_ids[at]))
            old_ids[at[better]] = ids[known][better]
            old_n[at] += n[known]
            keys, ids, n = np.concatenate([table, keys[~known]]), np.concatenate([old_ids, ids[~known]]), np.concatenate([old_n, n[~known]])
            known = np.arange(len(keys)) < len(table)
        raw = keys.tobytes()
        return pa.table([pa.array([raw[32 * i : 32 * i + 32] for i in range(len(keys))], pa.binary()), pa.array(ids, mask=ids == NONE), pa.array(n), pa.array(known)], ["digest", "keep_id", "group_size", "known"])

    return sharded(new, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, "digest binary, keep_id long, group_size long, known boolean")


def exact_duplicates(docs: DataFrame, history: str = "xxhash64(doc_id) % 2 = 0") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known of every row; ``history``: the condition of rows (doc_id, length) that count as seen before, the rest arrives as a new batch."""
    rows = shared(digests(docs))
    old, new = shared(grouped(rows.filter(f"coalesce({history}, false)"))), grouped(rows.filter(f"NOT coalesce({history}, false)"))
    shards = max(SPREAD * partitions(docs.sparkSession), -(-old.count() // SHARD_ROWS))
    found = resolve(new, build_index(old, shards), shards)
    out = rows.join(found, "digest")
    # among the winner's rows alone, one of those that repeat doc_id and text
    winner = out["doc_id"].eqNullSafe(out["keep_id"])
    twice = rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    out = out.withColumn("kept", winner)
    if twice:
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.desc("length")))).withColumn("kept", F.col("kept") & (F.col("place") == 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "known")
