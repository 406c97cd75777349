"""Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of the whole text, from its bytes. Training cuts each feature into quantile bins and boosts shallow trees
on the logistic loss, one feature after the other in cycles, with a small step; a feature's trees add up to one lookup table.
Then the pairs of features whose joint bins explain most of what is left get tables of two dimensions the same way. A score is
the logistic of the intercept and one table entry for each feature and pair: vectorised bin additions.

Labels come only from documents whose crc32(doc_id as text) mod 5 is not 0, at most ``SAMPLE`` of them (those with the least
hash of doc_id); language, source and doc_id are no inputs. Several labels of a document: the lowest counts. Without usable
labels every score is 0.5. Null text is empty; empty texts are scored like others. Null doc_id: not held out, never trained on. Rows
repeated: each gives a row; other columns are ignored; an empty table gives no rows; very long texts are measured whole. ``rejected`` documents are those with a score under ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U, bounded, marked, row_sums, shared, slices, strings, windows, words

SAMPLE, BINS, PAIRS, PAIR_BINS = 20_000, 32, 6, 8
ROUNDS, PAIR_ROUNDS, STEP, LEAVES, L2, LEAST = 120, 60, 0.1, 4, 1.0, 5
THRESHOLD, FOLDS = 0.3, 5
FEATURES = [
    "log_words", "word_length", "upper", "digits", "marks", "shouts", "symbols", "foreign", "lines", "line_length", "fresh_words", "repeated_shingles", "repeated_lines", "sentence_words", "capitalised", "marked_words", "one_letter",
]
BYTES = np.arange(256)
IS_UPPER, IS_DIGIT, IS_FOREIGN = (BYTES >= 65) & (BYTES <= 90), (BYTES >= 48) & (BYTES <= 57), BYTES >= 128
IS_ALPHA = IS_UPPER | (BYTES >= 97) & (BYTES <= 122) | IS_FOREIGN
IS_MARK, IS_SHOUT, IS_SYMBOL, IS_STOP = (np.isin(BYTES, list(x)) for x in (b".,;:'\"-()", b"!?", b"#$%&*@^~|<>=+_/\\{}[]`", b".!?"))
LINES = np.ones(256, bool)
LINES[10] = False


def _fresh(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct values of each row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    value, row = hashes[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(at) - 1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, offsets = strings(texts)
    out = [np.zeros((0, len(FEATURES)))]
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        size = np.maximum(np.diff(off), 1)
        count = lambda kind: row_sums(marked(part, kind).astype(U), off).astype(np.int64)  # noqa: B023, E731
        hashes, at = words(part, off, ~IS_SPACE)
        n = np.diff(at)
        some = np.maximum(n, 1)
        shingles, start = windows(hashes, at)
        lines, line_at = words(part, off, LINES)
        n_lines = np.maximum(np.diff(line_at), 1)
        space_at = marked(part, IS_SPACE)
        before = np.concatenate([[True], space_at[:-1]]) if len(part) else np.zeros(0, bool)
        before[off[:-1][off[:-1] < len(part)]] = True
        after = np.concatenate([space_at[1:], [True]]) if len(part) else before
        here = lambda mask: row_sums(mask.astype(U), off).astype(np.int64)  # noqa: B023, E731
        letters = np.maximum(count(IS_ALPHA), 1)
        space = count(IS_SPACE)
        out.append(np.stack([
            np.log1p(n), (np.diff(off) - space) / some, count(IS_UPPER) / letters, count(IS_DIGIT) / size, count(IS_MARK) / size, count(IS_SHOUT) / size, count(IS_SYMBOL) / size, count(IS_FOREIGN) / size,
            np.log1p(n_lines), np.log1p(size / n_lines), _fresh(hashes, at) / some, 1 - _fresh(shingles, start) / np.maximum(np.diff(start), 1), 1 - _fresh(lines, line_at) / n_lines, np.log1p(n / np.maximum(count(IS_STOP), 1)),
            here(before & marked(part, IS_UPPER)) / some, here(after & marked(part, IS_SYMBOL | IS_SHOUT)) / some, here(before & after & marked(part, IS_ALPHA)) / some,
        ], 1).astype(float))
    return np.concatenate(out)


class Model:
    """Lookup tables of features and pairs over their bins."""

    def __init__(self, cuts: list[np.ndarray], intercept: float):
        self.cuts, self.intercept = cuts, intercept
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[at[:, f]]
        for f, g, cf, cg, t in self.pairs:
            out += t[np.searchsorted(cf, x[:, f], "right"), np.searchsorted(cg, x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def shallow(grad: np.ndarray, hess: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree over ordered bins, grown best split first to ``LEAVES`` leaves; returns each bin's value."""
    leaves = [(0, len(grad))]
    g, h, c = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, n))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + L2)
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for a, b in leaves:
            m = np.arange(a + 1, b)
            m = m[(c[m] - c[a] >= LEAST) & (c[b] - c[m] >= LEAST)]
            if len(m):
                won = gain(a, m) + gain(m, b) - gain(a, b)
                if won.max() > best[0]:
                    best = (won.max(), (a, b), int(m[won.argmax()]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + L2)
    return out


def quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis over a table of bins: gain and values."""
    pad = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = pad(grad), pad(hess)
    a, b = grad.shape
    best, out = 0.0, np.zeros_like(grad)
    for i in range(1, a):
        for j in range(1, b):
            boxes = [(0, i, 0, j), (0, i, j, b), (i, a, 0, j), (i, a, j, b)]
            value = [(g[y, w] - g[x, w] - g[y, v] + g[x, v], h[y, w] - h[x, w] - h[y, v] + h[x, v]) for x, y, v, w in boxes]
            won = sum(s * s / (t + L2) for s, t in value) - g[a, b] ** 2 / (h[a, b] + L2)
            if won > best:
                best, out = won, np.zeros_like(grad)
                for (x, y, v, w), (s, t) in zip(boxes, value, strict=True):
                    out[x:y, v:w] = -s / (t + L2)
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model([np.zeros(0)] * len(FEATURES), 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model([quantiles(x[:, f], BINS) for f in range(x.shape[1])], float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    at, raw = model.bins(x), np.full(len(y), model.intercept)
    counts = [np.bincount(at[:, f], minlength=len(t)) for f, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            if len(t) > 1:
                p = 1 / (1 + np.exp(-raw))
                tree = STEP * shallow(np.bincount(at[:, f], p - y, len(t)), np.bincount(at[:, f], p * (1 - p), len(t)), counts[f])
                t += tree
                raw += tree[at[:, f]]
    coarse = [quantiles(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    low = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    shape = lambda f, g: (len(coarse[f]) + 1, len(coarse[g]) + 1)
    joint = lambda f, g, v: np.bincount(low[f] * shape(f, g)[1] + low[g], v, shape(f, g)[0] * shape(f, g)[1]).reshape(shape(f, g))
    p = 1 / (1 + np.exp(-raw))
    ranked = sorted(((quadrants(joint(f, g, p - y), joint(f, g, p * (1 - p)))[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)[:PAIRS]
    model.pairs = [(f, g, coarse[f], coarse[g], np.zeros(shape(f, g))) for _, f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, _, _, t in model.pairs:
            p = 1 / (1 + np.exp(-raw))
            tree = STEP * quadrants(joint(f, g, p - y), joint(f, g, p * (1 - p)))[1]
            t += tree
            raw += tree[low[f], low[g]]
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents and labels. Documents are joined with labels by doc_id alone; at most ``sample`` ids are broadcast, and features are computed for their documents only."""
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = plain.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct().join(marks, "doc_id").select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample)
    ids = shared(ids)
    known = feature_table(plain.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(ids), "doc_id")
    got = known.select("h", "x", "y").orderBy("h", "x").limit(sample).collect()
    return train(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], ["doc_id", "score"])

    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
