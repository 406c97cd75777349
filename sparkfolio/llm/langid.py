"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters (code points, in lower case) of a text give n-grams of one to three, hashed to ``WIDTH`` features; weights are
log(1 + count) * idf, scaled to length 1. Document frequencies come from all training documents. The regression is trained by
follow-the-regularised-leader (proximal, per-coordinate steps) with an elastic net, which leaves most weights zero; then one
temperature is fitted on training rows that the regression didn't see, so that scores are calibrated probabilities.

Learned only from text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0; the regression takes at most
``SAMPLE`` of them, an equal share for each language (those with the least hash of doc_id; ``LEAST_SHARE`` of each if languages are
many), a fifth of which go to the temperature. The prediction is a learned
lang value, or "und" with score 0 if the text is null, empty or has no letter, or nothing could be learned. Null doc_id: not held
out, never trained on. Rows repeated: each gives a row. Other columns are
ignored. Empty table: no rows. Very long texts are read whole, ``PART`` characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, shared, strings
from .gam import held_out
from .jaccard import BLOCKS, blocks, folded

WIDTH, GRAMS, SAMPLE, LEAST_SHARE = 4096, 3, 5_000, 50
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.5, 1.0, 3
UNKNOWN = "und"
#: Characters that are hashed at a time.
PART = 1 << 20


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of the hashed n-grams of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offsets = strings(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out = np.zeros(WIDTH, np.int64)
        points = np.frombuffer(data[a:b].tobytes().decode().encode("utf-32-le"), np.uint32)
        for i in range(0, len(points), PART):
            some = points[i : i + PART + GRAMS - 1]
            key = np.zeros(len(some), np.uint32)
            for n in range(1, GRAMS + 1):
                key = key[: len(key) - 1 if n > 1 else None] * np.uint32(0x01000193) + some[n - 1 :] + np.uint32(n)
                # the last part's overlap gives no further n-grams of its own
                own = key[: max(0, min(PART, len(points) - i - n + 1))]
                out += np.bincount(((own * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), minlength=WIDTH)
        yield out


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each feature occurs, and at the end the number of texts."""

    def run(batches):
        total = np.zeros(WIDTH + 64, np.int64)
        for batch in batches:
            for c in counts(batch.column(0)):
                total[:WIDTH] += c > 0
                total[-1] += 1
        if total.any():
            yield from blocks(total)

    return folded(texts.mapInArrow(run, BLOCKS), WIDTH + 64, np.int64, np.add)


def weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def weighed(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row that holds the features ``at`` alone: these and their weights."""
    return at, weigh(count.astype(np.float64), idf[at])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> np.ndarray:
    """Weights (features + 1 for the intercept, classes) after passes over the sparse rows in a fixed order."""
    width = WIDTH + 1
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1 * (at[:, None] < width - 1), 0, -(zi - np.sign(zi) * L1 * (at[:, None] < width - 1)) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(y)).tolist():
            at = np.append(x[i][0], width - 1)
            value = np.append(x[i][1], 1.0) * 4  # a scale on which the steps are neither tiny nor huge
            w = weights(at)
            p = softmax(value @ w)
            p[y[i]] -= 1
            g = value[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(width)) * 4


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, divisor: float):
        self.names, self.idf, self.weights, self.divisor = names, idf, weights, divisor

    def predict(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the class and its probability for rows of counts."""
        x = weigh(count, self.idf)
        p = softmax((x @ self.weights[:-1] + self.weights[-1]) / self.divisor)
        return p.argmax(1), p.max(1)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("string"), F.col("lang").cast("string"))
    # every language of the training rows is a class; each gives an equal share of the sample, and at least the fewest rows that a class needs
    names = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not names:
        return None
    share = max(LEAST_SHARE, sample // len(names))
    first = known.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= share).select("lang", "h")
    total = document_frequencies(known.select("text"))
    idf = np.log((1 + total[-1]) / (1 + total[:WIDTH])) + 1

    def sparse(batches):
        for batch in batches:
            at = [(np.flatnonzero(c), c) for c in counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.uint16).tobytes() for i, _ in at], pa.binary()), pa.array([c[i].astype(np.uint32).tobytes() for i, c in at], pa.binary()), batch.column(2)], ["h", "at", "n", "lang"])

    # at most ``sample`` (or LEAST_SHARE for each language) pairs are broadcast; rows of one doc_id share a hash, hence the second limit
    own = known.join(F.broadcast(shared(first)), ["lang", "h"], "left_semi").select("h", "text", "lang").mapInArrow(sparse, "h long, at binary, n binary, lang string")
    rows = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "at", "n"))).filter(F.col("place") <= share).orderBy("h", "lang", "at", "n").collect()
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[r.lang] for r in rows])
    x = [weighed(np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.uint32), idf) for r in rows]
    # the fifth row of each language is laid aside for the temperature
    aside = np.array([r.place % 5 == 0 for r in rows])
    w = ftrl([r for r, a in zip(x, aside, strict=True) if not a], y[~aside], len(names))
    logits = np.array([v @ w[at] + w[-1] for (at, v), a in zip(x, aside, strict=True) if a]).reshape(-1, len(names))
    return Model(names, idf, w, temperature(logits, y[aside]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    bounded(docs)
    model = train(docs)

    def run(batches):
        for batch in batches:
            texts, lettered = batch.column(1), np.asarray(batch.column(2).fill_null(False))
            guess, sure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for i in range(0, len(texts) if model else 0, 256):
                count = np.stack(list(counts(texts.slice(i, 256))))
                best, p = model.predict(count)
                there = lettered[i : i + 256]
                guess[i : i + 256][there] = np.array(model.names, object)[best[there]]
                sure[i : i + 256][there] = p[there]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(guess, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
