"""Helpers shared by the training-data operators: table reading, shared-storage checkpoints and vectorised text hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Texts are hashed in slices of about this many bytes, which bounds the memory of a Python worker.
SLICE_BYTES = 250_000
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Cut lineage through a checkpoint in the cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a local master takes a temporary folder; a cluster has no place that all share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the same folder. A checkpoint keeps the planner's guess of the size, which a loop of joins multiplies round by round until the numbers themselves fill the driver; a table's size is read from its files."""
    shared(df.sparkSession.range(1))  # makes sure that there is a folder
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to a Python worker at a time; texts and sets vary in size, so the default of 10,000 may hold hundreds of MB.
BATCH_ROWS = 500


def bounded(df: DataFrame) -> DataFrame:
    """Keep the session's Arrow batches small."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def freed(df: DataFrame) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer in use; it learns of them from the driver's garbage collector."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand: what Karp-Rabin needs to hash any substring in O(1)."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, self.base, U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, self.inverse, U)]))
        return self.up, self.down


POWERS = Powers()
#: Deletable white space: the characters 20 and 09 to 0D (hex).
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
#: Letters, digits and all bytes of non-ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def marked(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """inside[data], by the bytes' own translation, which needs no wide index."""
    return np.frombuffer(data.tobytes().translate(inside.astype(np.uint8).tobytes()), np.uint8 if inside.dtype != bool else bool)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (a run of bytes marked in ``inside``, A-Z in lower case) and the n + 1 offsets of the rows' words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    kept = marked(data, inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = edge[:-1].copy(), edge[1:].copy()
    first[0] = last[-1] = True
    first[1:] |= ~kept[:-1]
    last[:-1] |= ~kept[1:]
    starts = np.flatnonzero(kept & first)
    ends = np.flatnonzero(kept & last) + 1
    up, down = POWERS.upto(n)
    prefix = np.zeros(n + 1, U)
    letters = marked(data, LOWER).astype(U)
    letters += U(1)
    letters *= up[:n]
    np.cumsum(letters, out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(starts, offsets)


#: Odd multipliers of the words of a window, by place.
PLACES = mix(np.arange(1, 17, dtype=U)) | U(1)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of each row; a shorter row gives its whole sequence as one. Returns hashes and n + 1 offsets."""
    counts = np.diff(offsets)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(out)]).astype(np.int64)
    every = np.zeros(max(len(hashes) - size + 1, 0), U)
    for i in range(size if len(every) else 0):
        every += hashes[i : len(every) + i] * PLACES[i]
    first = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], out)
    short = np.flatnonzero((counts < size) & (counts > 0))
    value = np.zeros(at[-1], U)
    whole = np.ones(at[-1], bool)
    whole[at[short]] = False
    value[whole] = mix(every[first[whole]])
    for row in short.tolist():
        n = int(counts[row])
        value[at[row]] = mix((hashes[offsets[row] : offsets[row] + n] * PLACES[:n]).sum(dtype=U)[None] + U(n))[0]
    return value, at


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and their n + 1 offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.fromiter((len(x) for x in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2**64."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
