"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII characters in lower case. Karp-Rabin hashes of every run of five words join
documents to benchmark items (seeds, checked word by word). For each pair of a document and an item, tiling repeats: extend the
seeds to maximal matches, mark the longest one (then the first in the item, then in the document), drop seeds that touch marked
words, until no match of five words is left. Tiles never overlap and may come in any order, so reordered passages count. A pair
is reported when tiles cover at least 0.75 of the item's words.

Items are broadcast while their words are at most ``MOST_WORDS``; then no document moves. Beyond that, seeds of both sides are
joined by a shuffle, and pairs get both texts by joins. Items under five words, empty and null texts match nothing. Null doc_id
or item_id: compared like any other, reported with null. Rows repeated: each gives its pairs. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, SHINGLE_WORDS, U, bounded, slices, strings, windows, words

COVERAGE = 0.75
#: Words of items that are broadcast, at 16 bytes each: 64 MB.
MOST_WORDS = 4_000_000
OUT = "doc_id long, item_id long, n_tiles int, covered int, n_words int, coverage double, tiles array<struct<doc_word:int,item_word:int,length:int>>"


def tile(i: np.ndarray, j: np.ndarray, size: int = SHINGLE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, in the item, length) from seeds at i in the document and j in the item."""
    out = []
    while len(i):
        order = np.lexsort((j, i - j))
        i, j = i[order], j[order]
        cut = np.flatnonzero((np.diff(i - j) != 0) | (np.diff(j) != 1)) + 1
        first = np.concatenate([[0], cut])
        length = np.diff(np.append(first, len(i))) + size - 1
        best = min(np.flatnonzero(length == length.max()).tolist(), key=lambda x: (j[first[x]], i[first[x]]))
        a, b, n = int(i[first[best]]), int(j[first[best]]), int(length[best])
        out.append((a, b, n))
        free = ((i + size <= a) | (i >= a + n)) & ((j + size <= b) | (j >= b + n))
        i, j = i[free], j[free]
    return out


class Items:
    """Seeds of the benchmark's items in order of hash."""

    def __init__(self, ids: list, texts: pa.Array):
        data, offsets = strings(texts)
        self.ids = ids
        self.words, self.at = words(data, offsets, IS_WORD)
        seeds, start = windows(self.words, self.at)
        item = np.repeat(np.arange(len(ids)), np.diff(start))
        place = np.arange(len(seeds)) - start[item]
        long = np.diff(self.at)[item] >= SHINGLE_WORDS
        order = np.argsort(seeds[long], kind="stable")
        self.seeds, self.item, self.place = seeds[long][order], item[long][order], place[long][order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds >> U(44)).astype(np.int64)] = True

    def matches(self, hashes: np.ndarray, at: np.ndarray):
        """Seeds that rows share with items: row, place in the row, item, place in the item; in order of row and item."""
        seeds, start = windows(hashes, at)
        hit = np.flatnonzero(self.sieve[(seeds >> U(44)).astype(np.int64)])
        low, high = np.searchsorted(self.seeds, seeds[hit], "left"), np.searchsorted(self.seeds, seeds[hit], "right")
        n = high - low
        hit, low, n = hit[n > 0], low[n > 0], n[n > 0]
        k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.repeat(hit, n)
        row = np.searchsorted(start, hit, "right") - 1
        place = hit - start[row]
        same = np.diff(at)[row] >= SHINGLE_WORDS
        for w in range(SHINGLE_WORDS):
            same &= hashes[np.minimum(at[row] + place + w, max(len(hashes) - 1, 0))] == self.words[self.at[self.item[k]] + self.place[k] + w] if len(hashes) else same
        row, place, k = row[same], place[same], k[same]
        order = np.lexsort((self.item[k], row))
        return row[order], place[order], self.item[k[order]], self.place[k[order]]


def found(items: Items, ids: list, texts: pa.Array, least: float) -> list[tuple]:
    """The rows that ``contamination`` returns, for a batch of documents."""
    out = []
    data, offsets = strings(texts)
    sizes = np.diff(items.at)
    for a, b in slices(offsets):
        hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], IS_WORD)
        row, place, item, spot = items.matches(hashes, at)
        edges = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(row)], strict=True) if len(row) else []:
            m = int(item[x])
            if len(np.unique(spot[x:y])) * SHINGLE_WORDS < least * sizes[m]:
                continue  # even disjoint seeds would cover too little
            tiles = tile(place[x:y], spot[x:y])
            covered = sum(t[2] for t in tiles)
            if covered >= least * sizes[m]:
                out.append((ids[a + int(row[x])], items.ids[m], len(tiles), covered, int(sizes[m]), covered / int(sizes[m]), [dict(zip(("doc_word", "item_word", "length"), t, strict=True)) for t in tiles]))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("covered", pa.int32()), ("n_words", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())])))])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)


def _plain(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long"), F.col("text").cast("string"))


def broadcastable(benchmark: DataFrame) -> Items | None:
    """The items, if their bytes (words take two at least, with the space) keep within the bound."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if size.n + size.rows > 2 * MOST_WORDS:
        return None
    rows = benchmark.collect()
    return Items([r.item_id for r in rows], pa.array([r.text for r in rows], pa.string()))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """A row for each document and item whose tiles cover at least ``least`` of the item."""
    docs, benchmark = _plain(docs, "doc_id"), _plain(benchmark, "item_id")
    items = broadcastable(benchmark)
    bounded(docs)
    if items is None:
        return by_join(docs, benchmark, least)

    def run(batches):
        for batch in batches:
            yield batch_of(found(items, batch.column(0).to_pylist(), batch.column(1), least))

    return docs.mapInArrow(run, OUT)


def sharing(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, text, passage of every document and item that share a seed, by a shuffle join of seeds, then each pair's texts."""
    docs, benchmark = _plain(docs, "doc_id"), _plain(benchmark, "item_id")

    def seeds(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in slices(offsets):
                hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], IS_WORD)
                values, start = windows(hashes, at)
                row = np.repeat(np.arange(b - a), np.diff(start))
                keep = np.diff(at)[row] >= SHINGLE_WORDS
                pair = np.unique(np.stack([row[keep].astype(U), values[keep]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(pair[:, 0].astype(np.int64))), pa.array(pair[:, 1].view(np.int64))], ["key", "seed"])

    keyed = lambda t, k: t.withColumn("key", F.xxhash64(k, "text"))
    d, m = keyed(docs, "doc_id"), keyed(benchmark, "item_id")
    of = lambda t, key: t.select("key", "text").mapInArrow(seeds, "key long, seed long").withColumnRenamed("key", key)
    both = of(d, "d").join(of(m, "m"), "seed").select("d", "m").distinct()
    full = both.join(d.withColumnRenamed("key", "d"), "d").join(m.withColumnRenamed("key", "m").withColumnRenamed("text", "passage"), "m")
    return full.select("doc_id", "item_id", "text", "passage")


def by_join(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """The same for any number of items."""

    def pairs(batches):
        for batch in batches:
            rows = []
            for doc, item, text, passage in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                rows += found(Items([item], pa.array([passage])), [doc], pa.array([text]), least)
            yield batch_of(rows)

    return sharing(docs, benchmark).mapInArrow(pairs, OUT)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """The documents, all columns, that contain no item; in one pass while items are broadcast. Rows are judged by their texts, whatever their doc_id."""
    items = broadcastable(_plain(benchmark, "item_id"))
    bounded(docs)
    if items is None:

        def digests(batches):
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([sha for text, passage, sha in rows if found(Items([None], pa.array([passage])), [None], pa.array([text]), least)], pa.string())], ["sha"])

        dirty = sharing(docs, benchmark).select("text", "passage", F.sha2("text", 256)).mapInArrow(digests, "sha string").distinct()
        # a null text has no digest and stays
        return docs.join(dirty, F.sha2(docs["text"].cast("string"), 256) == dirty["sha"], "left_anti")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            dirty = {r[0] for r in found(items, list(range(batch.num_rows)), batch.column(at), least)}
            yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
