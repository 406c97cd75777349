"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids, each with an end id; longer ones than a sequence are cut so that all pieces but the first fill one.
Pieces have integer lengths up to the sequence's, so the whole bin-packing instance is a histogram of that many counts, however
many documents there are; it is solved on the driver. Reduction: for the longest piece j left, a set F of at most three pieces
is fixed in one sequence if it dominates every other feasible set with j: j alone if nothing fits beside it; j with the longest
fitting i if that fills the sequence or if no two pieces fit beside j; j with i, or with the heaviest fitting pair, if at most
two fit and it outweighs the alternatives. Equal cases are fixed together. What remains is packed by best fit, longest first.

The plan is a list of equal sequences ("fillings") with their number, so pieces only need their rank among those of the same
length. Ranks come from counts for each (length, salt) and a row number inside a salt; no task gets all pieces of a length.

Null and empty texts: one piece with the end id alone. Rows repeated, and null doc_id: each row is packed. Other columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, partitions, shared

SEQUENCE, END = 2048, 0


#: White space by any definition of it, and characters that some count as such.
SPACY = "\\s\x1c-\x1f\x85\xa0\u180e\u200b-\u200f\u2060\ufeff"
#: A space between two characters that are no white space: no pre-token of the byte-level pattern reaches across it.
BETWEEN = re.compile(f"(?<=[^{SPACY}]) (?=[^{SPACY}])")
# Ranges of characters that are letters in every version of Unicode, and the byte-level pattern over them and ASCII.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
PATTERN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Any character beside those, for which the pattern isn't used.
OTHER = re.compile(rf"[^\x00-\x7f{LETTERS}]")
#: Parts of texts whose ids a worker remembers, and the longest of them in characters.
MOST_KNOWN, LONGEST_KNOWN = 400_000, 64


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the others are letters from 256 on."""
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
    return {x: chr(256 + i) for i, x in enumerate(hidden)}


class Known(dict):
    """Ids of parts of texts, computed once for each part; forgotten when there are too many."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, part: str) -> bytes:
        ids = self.compute(part)
        if len(part) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Ids of texts, by tokenizers. Texts are encoded part by part if the file's settings make the parts' ids those of the whole
    (byte-level pattern, no normaliser, added tokens without white space or stripping): texts of ASCII and ``LETTERS`` by
    pre-tokens, other texts word by word, each with the space before it. Words that hold other characters or an added token, and
    all texts under another file, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        told, letters = json.loads(self.own.to_str()), byte_letters()
        before, model = told["pre_tokenizer"] or {}, self.own.model
        self.added = [x["content"] for x in told["added_tokens"]]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(f"[{SPACY}]", x["content"]) for x in told["added_tokens"])
        self.splits = plain and not told["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and told["model"]["type"] == "BPE" and not told["model"]["dropout"]

        def compute(x: str) -> bytes:
            ids = [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(letters))]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.tokens = Known(compute)
        self.words = Known(lambda x: self.part(" " + x))

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, PATTERN.findall(text))) if self.known(text) else self.whole(text)

    def known(self, text: str) -> bool:
        return not (OTHER.search(text) or any(x in text for x in self.added))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.splits:
            return self.whole(text)
        if self.known(text):
            return self.part(text)
        first, *rest = BETWEEN.split(text)
        return self.part(first) + b"".join(map(self.words.__getitem__, rest))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``tokens`` would be ids[start : start + length]."""
    last = end.to_bytes(4, "little")

    def run(batches):
        own = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(own.ids(text.as_py() or "") + last)
                n = len(ids) // 4
                cuts = [0, *range(n % sequence or sequence, n + 1, sequence)]
                out += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Instance:
    """Counts of lengths, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k shortest pieces beside one of length ``without``."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(k - len(out), self.counts[x] - (x == without))
            if len(out) >= k:
                break
        return out

    def largest(self, most: int, *without: int) -> int:
        """The longest piece up to ``most`` beside those named; 0 if none."""
        i = bisect_left(self.lengths, most + 1) - 1
        while i >= 0:
            if self.counts[self.lengths[i]] > without.count(self.lengths[i]):
                return self.lengths[i]
            i -= 1
        return 0


def dominating(instance: Instance, j: int, size: int) -> tuple[int, ...] | None:
    """A set of j and at most two other pieces that dominates every feasible set with j, if there is a proof."""
    room, low = size - j, instance.smallest(3, j)
    i = instance.largest(room, j)
    if not i:
        return (j,)
    if i == room or len(low) < 2 or low[0] + low[1] > room:
        return (j, i)
    if len(low) > 2 and sum(low) <= room:
        return None
    a = b = 0  # the heaviest pair that fits
    for x in reversed(instance.lengths[: bisect_left(instance.lengths, room)]):
        if 2 * x < a + b:
            break
        y = instance.largest(min(room - x, x), j, x)
        if y and x + y > a + b:
            a, b = x, y
    if i >= a + b:
        return (j, i)
    if a == i and instance.largest(room - a, j, a) == b:
        # the longer piece of any other pair is at most a; if it is shorter than a, the other one is no longer than it
        second = next((x for x in reversed(instance.lengths) if x < a), 0)
        if a == b or min(second, room - low[0]) <= b:
            return (j, a, b)
    return None


def reduce(instance: Instance, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, longest pieces first, until no piece left allows a proof; returns fillings and their numbers."""
    fixed, more = [], True
    while more:
        more = False
        for j in instance.lengths[::-1]:
            while instance.counts.get(j) and (best := dominating(instance, j, size)):
                n = min(instance.counts[x] // best.count(x) for x in set(best))
                for x in set(best):
                    instance.take(x, n * best.count(x))
                fixed.append((best, n))
                more = True
    return fixed


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: equal sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room -> [filling, number]
    rooms: list[int] = []

    def put(filling: tuple[int, ...], room: int, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([filling, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                filling, room, there = (), size, left
            else:
                room = rooms[i]
                filling, there = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = room // length
            full = min(there, left // each)
            if full:
                put(filling + (length,) * each, room - each * length, full)
            left -= full * each
            there -= full
            if left and there:
                put(filling + (length,) * left, room - left * length, 1)
                left, there = 0, there - 1
            if there and filling:
                put(filling, room, there)
    return [(f, n) for x in open_.values() for f, n in x]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int, bool]]:
    """Fillings (lengths in order), the number of such sequences, and whether dominance fixed them."""
    instance = Instance(counts)
    fixed = reduce(instance, size)
    return [(f, n, True) for f, n in fixed] + [(f, n, False) for f, n in best_fit(instance.counts, size)]


def places(fillings: list[tuple[tuple[int, ...], int, bool]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in order of rank: the n pieces from first rank on go to as many sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for filling, n, _ in fillings:
        offset = 0
        for length in filling:
            rows.setdefault(length, []).append((rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = shared(pieces(docs, path, sequence, end).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(docs.sparkSession))).cast("int")))
    counts = shared(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    # at most as many rows as a sequence has tokens; each step of the plan uses up a length or a group of rooms, so its size, too, follows the sequence's and not the data's
    where = places(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, sequence))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    inside = cut.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = inside.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def seat(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            ids, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for some in np.split(order, edges) if len(order) else []:
                table = where[int(length[some[0]])]
                at = np.searchsorted(table[:, 0], rank[some], "right") - 1
                ids[some], offsets[some] = table[at, 1] + rank[some] - table[at, 0], table[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(ids), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
