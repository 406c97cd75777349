"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Sizes fall into bands [l, 4l/3], so that sets at
Jaccard 3/4 lie in one band or in two neighbouring ones; each set takes part in the instance of its own band and of the next.
Linked sets r and s differ in at most k = (|r| + |s|) / 7 shingles. An instance splits the domain of shingles by hash into ``n1``
parts and each of these into ``n2``, and enumerates in each first-level part the subsets of n2 - k2 second-level parts, where
n1 * (k2 + 1) > k; a signature is the projection of the set on a subset, so linked sets share one. ``instance`` chooses:

* up to k = 3 (sets of up to 13 shingles) n1 = 1, k2 = k, n2 = k + 3: all subsets of three parts, 4, 10 or 20 signatures;
* beyond, n2 = 1 and k2 = 0, since there larger subsets cost many times the signatures (for k = 28 subsets of two out of four parts
  need 60 that hold 5 shingles each, and parts alone 29 that hold 3.5). n1 is a power of four from the band's end on, so that
  neighbouring bands mostly have the same parts and a set its signatures but once. Differences spoil at most k of the signatures
  of either set, so in every order of signatures there is a shared one among the first k + 1 of each: rare ones go first (by
  hashed counts over all sets), which keeps boilerplate out, and the others aren't emitted.

Sets for which a subset is empty, or which fill k parts or fewer, emit each shingle as a signature besides.

Equal sets are one class, named by 128 bits of digest. Signatures travel as 40 bits beside 48 bits of the class, which only choose
candidates. The member of a group that shares the most signatures stands for it (its centre); every class is first checked against the
centre with which it shares the most, and linked classes merge. What is left are, for each centre, the classes outside its component:
they are compared among each other and with those inside by parities of cells, in blocks of ``BLOCK`` (so a large group is many
tasks, and members of one component are never paired), and pairs that cells leave possible are checked. Every check is exact. Nothing
is capped or sampled. A centre with m classes outside and n inside its component costs m * (m + n) comparisons of cells.

Nulls and empty texts: the empty set, which links with nothing. Null doc_id: the row stays, unlinked, with null component_id.
Rows repeated: each gives a row. Other columns are ignored. Empty table: no rows. Very long texts are cut into shingles like others,
one at a time. Hashes of shingles have 64 bits; a collision would need two different shingles among those of one pair of sets (or,
for words of over 1,000 characters, a text built for it).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U, bounded, distinct, freed, mix, partitions, row_sums, shared, slices, strings, windows, words, written

#: Hashed counters that order signatures by how common they are.
COUNTERS = 1 << 19
SHIFT = U(64 - 19)
#: Signatures that a task gathers before it deals them out to buckets, and bytes of signatures in a bucket, about.
FLUSH, BUCKET_BYTES = 500_000, 48_000_000
#: Bytes of a signature beside its bucket, and of its class.
SIGN, OWNER = 5, 6
#: Members of a group in one row, and classes of a block of comparisons.
CHUNK, BLOCK = 20_000, 1_000
#: Least logarithm of the number of cells in which two sets are compared before their shingles are moved.
LEAST_LEVEL = 6
#: Sets of bands up to this k get subsets of three parts.
MOST_K = 3
#: Classes in a broadcast filter (16 MB); more are selected by a join alone.
MOST_WANTED = 4_000_000


def bands(largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    low, lows, highs = 1, [], []
    while low <= largest:
        lows.append(low)
        highs.append(4 * low // 3)
        low = highs[-1] + 1
    return np.array(lows, np.int64), np.array(highs, np.int64)


LOWS, HIGHS = bands()


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end, and their distinct shingles with offsets."""
    data, offsets = strings(texts)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        yield a, b, *distinct(*windows(*words(part, offsets[a : b + 1] - offsets[a], IS_SPACE == False)))  # noqa: E712


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; both 0 only for empty sets."""
    sizes = np.diff(offsets).astype(U)
    return mix(row_sums(mix(values + U(1)), offsets) + sizes) | (sizes > 0).astype(U), mix(row_sums(mix(values ^ U(0xA5A5A5A5A5A5A5A5)), offsets) + sizes)


def level(sizes: np.ndarray) -> np.ndarray:
    """Logarithm of the number of cells of sets of these sizes: two to four cells for each shingle."""
    return np.maximum(np.frexp(np.maximum(sizes, 1))[1] + 1, LEAST_LEVEL).astype(np.int64)


def cells(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Size of each set in 4 bytes, then for each cell one bit: whether the number of shingles in it is odd."""
    sizes = np.diff(offsets)
    width = 1 << level(sizes)
    start = np.concatenate([[0], np.cumsum(width)])
    place = (values >> U(7)).astype(np.int64) & np.repeat(width - 1, sizes)
    out = np.packbits((np.bincount(np.repeat(start[:-1], sizes) + place, minlength=start[-1]) & 1).astype(bool)).tobytes()
    start >>= 3
    return [n.to_bytes(4, "little") + out[a:b] for n, a, b in zip(sizes.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True)]


def folded_cells(raw: bytes, size: int) -> np.ndarray:
    """The cells in 64-bit words, folded to ``size`` bytes."""
    out = np.frombuffer(raw, np.uint8, offset=4)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return np.ascontiguousarray(out).view(U)


def possible(a: bytes, b: bytes) -> bool:
    """Whether cells leave a link possible: two sets differ in at least as many shingles as they differ in cells, and linked ones in at most a seventh of their sizes' sum."""
    n, m = int.from_bytes(a[:4], "little"), int.from_bytes(b[:4], "little")
    size = min(len(a), len(b)) - 4
    return 100 * min(n, m) >= 75 * max(n, m) and 7 * int(np.bitwise_count(folded_cells(a, size) ^ folded_cells(b, size)).sum(dtype=np.int64)) <= n + m


def possible_pairs(node: np.ndarray, component: np.ndarray, raw: list[bytes], role: np.ndarray, inner: bool) -> Iterator[np.ndarray]:
    """Pairs of a block's members in different components that cells leave possible, each set against those of its size up to 4/3 of
    it: members of roles 0 and 1, and if ``inner`` those of role 1 among each other."""
    n = np.array([int.from_bytes(x[:4], "little") for x in raw])
    order = np.argsort(n, kind="stable")
    node, component, n, role, raw = node[order], component[order], n[order], role[order], [raw[i] for i in order.tolist()]
    ends, levels = np.searchsorted(n, 4 * n // 3, "right"), level(n)
    for to in np.unique(levels).tolist():
        first, last = np.searchsorted(levels, to), np.searchsorted(levels, to, "right")
        some = np.stack([folded_cells(x, 1 << (to - 3)) for x in raw[first : ends[last - 1]]])
        for i in range(first, last):
            other = role[i + 1 : ends[i]]
            near = i + 1 + np.flatnonzero((component[i + 1 : ends[i]] != component[i]) & ((other != role[i]) | (inner & (other == 1))))
            if len(near):
                apart = np.bitwise_count(some[near - first] ^ some[i - first]).sum(1, dtype=np.int64)
                near = near[7 * apart <= n[near] + n[i]]
                if len(near):
                    yield np.stack([np.minimum(node[near], node[i]), np.maximum(node[near], node[i])], 1)


def instance(high: int) -> tuple[int, int, int]:
    """n1, n2, k2 of the band that ends with sets of size ``high``; n1 = 0 if only equal sets can link."""
    k = 2 * high // 7
    if k == 0:
        return 0, 1, 0
    return (1, k + 3, k) if k <= MOST_K else (4 ** int(np.ceil(np.log2(high) / 2)), 1, 0)


N1, N2, K2 = (np.array(x, np.int64) for x in zip(*map(instance, HIGHS.tolist()), strict=True))
#: Bands that share parts share a level.
LEVEL = N1 * 64 + N2


def subsets(values: np.ndarray, row: np.ndarray, rows: int, n2: int, k2: int, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures and rows: projections on all subsets of n2 - k2 parts, but empty ones; a row that has an empty one gives its shingles too."""
    part = ((mix(values ^ U(0x5BD1E995)) >> U(20)) % U(n2)).astype(np.int64)
    at = row * n2 + part
    sums = np.zeros(rows * n2, U)
    np.add.at(sums, at, mix(values + U(3)))
    counts = np.bincount(at, minlength=rows * n2)
    content = mix(sums + mix(np.tile(np.arange(n2, dtype=U), rows) + salt) + counts.astype(U)).reshape(rows, n2)
    counts = counts.reshape(rows, n2)
    for some in combinations(range(n2), n2 - k2):
        there = np.flatnonzero(counts[:, some].sum(1) > 0)
        yield mix(content[:, some].sum(1, dtype=U)[there] + U(sum(1 << x for x in some))), there
    hollow = (counts == 0).sum(1) >= n2 - k2
    alone = hollow[row]
    yield mix(values[alone] + mix(salt + U(1 << 50))), row[alone]


def signatures(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For the instances of each set: signature, row, and the number of signatures that the row can lose (or None: all are needed)."""
    sizes = np.diff(offsets)
    band = np.searchsorted(HIGHS, sizes, "left")
    need = [(sizes + np.minimum(HIGHS[band + step], 4 * sizes // 3)) // 7 for step in (0, 1)]
    for one in np.unique(np.concatenate([LEVEL[band], LEVEL[band + 1]])).tolist():
        n1, n2 = divmod(one, 64)
        own, after = LEVEL[band] == one, LEVEL[band + 1] == one
        here = (own | after) & (sizes > 0)
        if not n1 or not here.any():
            continue
        at = np.flatnonzero(here)
        lost = np.maximum(np.where(own, need[0], 0), np.where(after, need[1], 0))[at]
        value, row = values[np.repeat(here, sizes)], np.repeat(np.arange(len(at)), sizes[at])
        salt = mix(np.array([one], U))
        if n2 > 1:
            for sign, rows in subsets(value, row, len(at), n2, n2 - 3, salt):
                yield sign, at[rows], None
            continue
        part = ((mix(value ^ U(0x5BD1E995)) >> U(20)) & U(n1 - 1)).astype(np.int64)
        order = np.argsort(row * n1 + part)
        row, part, value = row[order], part[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        sums = np.add.reduceat(mix(value + U(3)), first)
        counts = np.diff(np.append(first, len(row))).astype(U)
        owner = row[first]
        yield mix(sums + mix(part[first].astype(U) + salt) + counts), at[owner], lost[owner]
        few = np.bincount(owner, minlength=len(at)) <= lost
        if few.any():
            alone = few[row]
            yield mix(value[alone] + mix(salt + U(1 << 50))), at[row[alone]], None


def rarest(sign: np.ndarray, row: np.ndarray, lost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the signatures that come first by count, then by bits; those that tie with the last one needed stay as well."""
    key = (row.astype(U) << U(42)) | (rank[(sign >> SHIFT).astype(np.int64)] << U(20)) | (mix(sign) >> U(44))
    order = np.argsort(key)
    key, row, lost = key[order], row[order], lost[order]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(begin, len(row)))
    keep = key <= np.repeat(key[begin + np.minimum(lost[begin], size - 1)], size)
    return sign[order[keep]], row[keep]


BLOCKS = "block long, content binary"


def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array in 64 rows, for ``folded``."""
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([x.tobytes() for x in total.reshape(64, -1)], pa.binary())], ["block", "content"])


def folded(parts: DataFrame, size: int, kind: type, op: np.ufunc) -> np.ndarray:
    """Fold arrays of a fixed size that tasks sent as ``blocks``, block by block on the executors; only the result reaches the driver."""

    def fold(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(content, kind)
                total[block] = op(total[block], own) if block in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "content"])

    out = np.zeros((64, size // 64), kind)
    for row in parts.repartition(min(64, max(8, partitions(parts.sparkSession))), "block").mapInArrow(fold, BLOCKS).toLocalIterator():
        out[row.block] = op(out[row.block], np.frombuffer(row.content, kind))
    return out.ravel()


TABLE = "doc_id long, node binary, n_shingles long, block long, content binary"


def names(one: np.ndarray, two: np.ndarray) -> pa.Array:
    """Digests of classes as 16 bytes each."""
    raw = np.stack([one, two], 1).astype("<u8").tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def class_table(docs: DataFrame) -> DataFrame:
    """doc_id, node (name of the class), n_shingles of every document; and rows of hashed counts of all signatures, as ``blocks``: a fixed number of counters for each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("block", pa.int64()), ("content", pa.binary())])

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for a, b, values, offsets in shingle_sets(batch.column(1)):
                for sign, _, _ in signatures(values, offsets):
                    total += np.bincount((sign >> SHIFT).astype(np.int64), minlength=COUNTERS)
                n = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), names(*digests(values, offsets)), pa.array(np.diff(offsets)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        if total.any():
            for part in blocks(np.minimum(total, 2**31 - 1).astype(np.int32)):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in list(schema)[:3]), part.column(0), part.column(1)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TABLE)


def keys(cls: np.ndarray) -> np.ndarray:
    """The bits of a class's digest that travel with signatures."""
    return cls >> U(64 - 8 * OWNER)


def low_bytes(values: np.ndarray, n: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(U)


def signature_groups(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Distinct groups of classes that share a signature, by two digests of their members: members (sorted keys, in chunks), their number, and the number of signatures that they share."""
    # counters hold all signatures, of which sets emit half at most
    buckets = max(partitions(docs.sparkSession), int(common.sum(dtype=np.int64)) // 2 * (SIGN + OWNER) // BUCKET_BYTES)
    rank = np.clip(common, 0, 2**22 - 1).astype(U)

    def emit(held):
        sign, owner = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (sign >> U(8 * SIGN)) % U(buckets)
        sign &= U((1 << 8 * SIGN) - 1)
        order = np.lexsort((owner, sign, bucket))
        sign, owner, bucket = sign[order], owner[order], bucket[order]
        new = np.concatenate([[True], (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])])
        sign, owner, bucket = sign[new], owner[new], bucket[new]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int64)), *(pa.array([low_bytes(v[a:b], n) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for v, n in ((sign, SIGN), (owner, OWNER)))], ["bucket", "signs", "owners"])

    def deal(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column(0)):
                own = keys(digests(values, offsets)[0])
                for sign, row, lost in signatures(values, offsets):
                    if lost is not None:
                        sign, row = rarest(sign, row, lost, rank)
                    held.append((sign, own[row]))
                    n += len(sign)
                if n >= FLUSH:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    def group(batches):
        signs, owners = [], []
        for batch in batches:
            for bucket, sign, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                signs.append(from_low_bytes(sign, SIGN) | U(bucket << 8 * SIGN))
                owners.append(from_low_bytes(owner, OWNER))
        if not signs:
            return
        sign, owner = np.concatenate(signs), np.concatenate(owners)
        del signs, owners
        order = np.argsort(sign, kind="stable")
        sign, owner = sign[order], owner[order]
        same = sign[1:] == sign[:-1]
        shared_one = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        sign, owner = sign[shared_one], owner[shared_one]
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])
        sign, owner = sign[new], owner[new]
        cut = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1, [len(sign)]]).astype(np.int64)
        several = np.flatnonzero(np.diff(cut) > 1)
        one, two = (mix(row_sums(mix(owner + U(x)), cut) + np.diff(cut).astype(U)) for x in (9, 1 << 60))
        _, at, weight = np.unique(np.stack([one[several], two[several]], 1), axis=0, return_index=True, return_counts=True)
        rows, held = [], 0
        for i, w in zip(several[at].tolist(), weight.tolist(), strict=True):
            a, b = int(cut[i]), int(cut[i + 1])
            for c in range(a, b, CHUNK):
                rows.append((one[i].view(np.int64), two[i].view(np.int64), (c - a) // CHUNK, owner[c : min(b, c + CHUNK)].view(np.int64), b - a, w))
                held += min(b - c, CHUNK)
                if held >= 10 * CHUNK:
                    yield group_rows(rows)
                    rows, held = [], 0
        if rows:
            yield group_rows(rows)

    dealt = docs.select(F.col("text").cast("string")).mapInArrow(deal, "bucket long, signs binary, owners binary").repartition(buckets, "bucket")
    return dealt.mapInArrow(group, "g1 long, g2 long, chunk int, members array<long>, size long, weight long").groupBy("g1", "g2", "chunk").agg(F.first("members").alias("members"), F.first("size").alias("size"), F.sum("weight").alias("weight"))


def group_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["g1", "g2", "chunk", "members", "size", "weight"])


def class_rows(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """node, key and ``cells`` or ``shingles`` (64 bits each) of every class whose key is wanted (``key`` of ``wanted``, distinct), and of a few others."""
    few = wanted.count()
    bits = 1 << max(16, int(few * 16).bit_length())
    packed = None
    if few <= MOST_WANTED:

        def mark(batches):
            out = np.zeros(bits, bool)
            for batch in batches:
                h = mix(np.asarray(batch.column(0)).view(U))
                out[(h % U(bits)).astype(np.int64)] = out[((h >> U(32)) * U(31) % U(bits)).astype(np.int64)] = True
            yield from blocks(np.packbits(out))

        packed = folded(wanted.mapInArrow(mark, BLOCKS), bits // 8, np.uint8, np.bitwise_or)

    def rows(batches):
        there = None if packed is None else np.unpackbits(packed).view(bool)
        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column(0)):
                one, two = digests(values, offsets)
                key = keys(one)
                h = mix(key)
                keep = np.diff(offsets) > 0
                if there is not None:
                    keep &= there[(h % U(bits)).astype(np.int64)] & there[((h >> U(32)) * U(31) % U(bits)).astype(np.int64)]
                at = np.flatnonzero(keep)
                at = at[np.unique(np.stack([one[at], two[at]], 1), axis=0, return_index=True)[1]]
                if len(at):
                    sizes = np.diff(offsets)[at]
                    start = np.concatenate([[0], np.cumsum(sizes)])
                    own = values[np.repeat(offsets[at] - start[:-1], sizes) + np.arange(start[-1])]
                    raw = own.astype("<u8").tobytes()
                    content = cells(own, start) if column == "cells" else [raw[8 * x : 8 * y] for x, y in zip(start.tolist(), start[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([names(one[at], two[at]), pa.array(key[at].view(np.int64)), pa.array(content, pa.binary())], ["node", "key", column])

    made = docs.filter("doc_id IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(rows, f"node binary, key long, {column} binary")
    if packed is None:
        made = made.join(wanted, "key", "left_semi")
    return made.groupBy("node").agg(F.first("key").alias("key"), F.first(column).alias(column))


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, node, key, cells of the classes whose key is wanted. Ids are numbers that hold for the checkpoint."""
    return shared(class_rows(docs, wanted, "cells").withColumn("id", F.monotonically_increasing_id()))


def checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= 75 * union of their shingles, which are read from the documents once more."""
    named = shared(sets.select("id", "node", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"))
    own = shared(class_rows(docs, named.select("key").distinct(), "shingles").join(named.select("id", "node"), "node").select("id", "shingles"))

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= 75 * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return with_both(pairs, own, "shingles").mapInArrow(compare, "a long, b long")


def with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b, x, y: pairs of classes with a column of each."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col(column).alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node of an edge (a, b): least label along links, by alternating neighbour minima and pointer jumps over written tables."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("component").alias("c")), "next").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        # a label is itself a node: take the label's label as well
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = written(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("far", "c")).alias("component"), (F.least("c", F.coalesce("far", "c")) < F.col("component")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def stars(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, w: centres, the classes of their groups (themselves too) and the number of signatures that these share there."""
    # groups of equal g1 would be joined, which only adds candidates
    flat = shared(groups.select("g1", F.explode("members").alias("key"), "size", "weight").join(sets.select("key", F.col("id").alias("b")), "key").select("g1", "b", "size", "weight"))
    degree = flat.groupBy("b").agg(F.sum(F.col("weight") * (F.col("size") - 1)).alias("degree"))
    centre = flat.join(degree, "b").groupBy("g1").agg(F.max_by("b", F.struct("degree", "b")).alias("a"))
    return shared(flat.join(centre, "g1").groupBy("a", "b").agg(F.sum("weight").alias("w")))


def compared(star: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes of one centre but of different components that cells leave possible."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    held = star.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("cb", "b").alias("component"), (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("outside"))
    counts = held.groupBy("a").agg(F.sum(F.col("outside").cast("long")).alias("m"), F.sum((~F.col("outside")).cast("long")).alias("n")).filter("m > 0")
    held = held.join(counts.select("a", F.ceil(F.col("m") / BLOCK).cast("int").alias("m"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n")), "a")
    # block (i, j): outsiders i against insiders j, and if j = 0 among each other; from j = n on, against outsiders j - n
    own = F.pmod(F.xxhash64("b"), F.when(F.col("outside"), F.col("m")).otherwise(F.col("n")).cast("long")).cast("int")
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    inside = F.transform(upto(F.col("m")), lambda i: place(i, F.col("own"), F.lit(0)))
    against = F.transform(upto(F.col("n")), lambda j: place(F.col("own"), j, F.lit(1)))
    others = F.transform(F.filter(upto(F.col("m")), lambda i: i != F.col("own")), lambda i: place(F.least("own", i), F.col("n") + F.greatest("own", i), F.col("own") > i))
    dealt = held.withColumn("own", own).select("a", "b", "component", F.explode(F.when(F.col("outside"), F.concat(against, others)).otherwise(inside)).alias("at")).select("a", "b", "component", "at.*")
    listed = dealt.join(sets.select(F.col("id").alias("b"), "cells"), "b").groupBy("a", "i", "j").agg(F.collect_list(F.struct("b", "component", "role", "cells")).alias("members"))

    def cross(batches):
        for batch in batches:
            out: list[np.ndarray] = []
            held = 0
            for j, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = members.values
                for pairs in possible_pairs(*(np.asarray(flat.field(i)) for i in (0, 1)), flat.field(3).to_pylist(), np.asarray(flat.field(2)), j == 0):
                    out.append(pairs)
                    held += len(pairs)
                    if held > 500_000:
                        yield unique_pairs(out)
                        out, held = [], 0
            if out:
                yield unique_pairs(out)

    return listed.select("j", "members").mapInArrow(cross, "a long, b long").distinct()


def unique_pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    some = np.unique(np.concatenate(parts), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], ["a", "b"])


def linked(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """node, label: the classes that have links, by their names, and the number of their component."""
    groups = shared(signature_groups(docs.filter("doc_id IS NOT NULL"), common))
    freed(docs)
    sets = class_sets(docs, groups.select(F.explode("members").alias("key")).distinct())
    star = stars(groups, sets)
    freed(docs)
    # each class against the centre with which it shares the most signatures
    best = star.filter("a <> b").groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a"))

    def sieve(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array([possible(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_()))

    best = shared(with_both(best, sets, "cells").mapInArrow(sieve, "a long, b long"))
    freed(docs)
    first = shared(checked(best, sets, docs))
    labels = components(first)
    freed(docs)
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = shared(compared(star, labels, sets).join(tried, ["a", "b"], "left_anti"))
    freed(docs)
    more = shared(checked(pairs, sets, docs)) if pairs.limit(1).count() else None
    if more is not None and more.limit(1).count():
        labels = components(first.union(more))
    freed(docs)
    return labels.join(sets.select(F.col("id"), "node").withColumnRenamed("node", "name"), F.col("node") == F.col("id")).select(F.col("name").alias("node"), F.col("component").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and class_size (documents with an equal set)."""
    table = shared(class_table(bounded(docs)))
    rows = table.filter("block IS NULL").select("doc_id", "node", "n_shingles")
    common = folded(table.filter("block IS NOT NULL").select("block", "content"), COUNTERS, np.int32, np.add)
    classes = shared(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")))
    labels = linked(docs, common)
    named = shared(classes.join(labels, "node", "left"))
    heads = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("head"))
    own = named.join(heads, "label", "left").select("node", F.coalesce("head", "least").alias("component_id"), "class_size")
    return (
        rows.withColumn("node", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")))
        .join(own, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    )
