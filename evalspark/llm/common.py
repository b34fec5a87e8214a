"""Helpers shared by the operators: reading, intermediate tables, word hashes of Arrow batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.scaling import materialize

# Bytes of text that one vectorised step works on; temporaries take about 60 times as much.
STEP_BYTES = 1 << 19
# The same for steps whose results do not depend on how rows are put together: their temporaries stay in a core's cache.
ROW_BYTES = 1 << 17
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
# [\x20\x09-\x0D] separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


# Bytes of rows that reach a Python worker at once: as much is held by the JVM and by the worker, for every running step.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Unless the session says otherwise, steps over it get batches of bounded bytes."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder, so that later reads survive a lost executor."""
    return materialize(df, f"llm-{name}")


def pieces(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `size` bytes of text each, one row at least."""
    ends = np.cumsum(np.diff(_offsets(batch.column(column))))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between batches and stages, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    if buffer is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(buffer, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)
    return at.astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offset of each row in them; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    at = _offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [first, last), runs in order, apart and not empty."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = last - first
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(starts, sizes)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), ODD)]))
    taken = data if total == len(data) else data[np.arange(total) + np.repeat(first - starts, sizes)]
    return mix(np.add.reduceat(BYTE_CODES[taken] * powers[place], starts) + sizes.astype(np.uint64))


class Words:
    """Words of the rows of a text column: hashes, byte places, and the words before each row.

    `gaps` marks the bytes that separate words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE):
        self.data, self.at = text_bytes(texts)
        if lower and len(self.data):
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + upper.astype(np.uint8) * np.uint8(32)
        gap = gaps[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.at] = True
        inside = np.concatenate([[True], gap, [True]])
        starts = ~gap & (inside[:-2] | edge[:-1])
        ends = ~gap & (inside[2:] | edge[1:])
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.hash = run_hashes(self.data, self.first, self.last)
        self.row_at = np.searchsorted(self.first, self.at)
        self.count = np.diff(self.row_at)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values; one fewer than `size` results fall away at the end."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * ODD + words[k : k + len(out)]
    return mix(out)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node id that is reachable over the edges, for every node that has an edge.

    Alternates large-star and small-star steps: each is one grouping and one join, rows stay linear in the
    edges, and a hub is only ever the hub of a star, whose minimum is combined before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    pairs = kept_table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = kept_table(large.where("u != v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        joined = large.join(low, "u")
        small = joined.where("v != w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        after = kept_table(small.union(low.select("u", F.col("w").alias("v"))).distinct(), "small")
        # A star forest: no node is both a leaf and a centre, and every leaf has one centre.
        leaves = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        crossed = leaves.join(after.select(F.col("v").alias("u")), "u", "left_semi")
        pairs = after
        if leaves.where("n > 1").isEmpty() and crossed.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# Bits of the bitmap of `Bitmap`: 1 MB on driver and tasks, whatever the data size.
BITMAP_BITS = 1 << 23


class Bitmap:
    """Approximate set of 64-bit ids in a fixed number of bits.

    It only spares the shuffle of rows that cannot match: members always pass, and the more ids there are, the more
    others pass too, up to all. Results never depend on it.
    """

    def __init__(self, ids: DataFrame, column: str):
        bit = self.bit(column)
        word = ids.select(F.floor(bit / 64).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).distinct()
        rows = word.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("v")).collect()
        words = np.zeros(BITMAP_BITS // 64, np.int64)
        for w, v in rows:  # BITMAP_BITS / 64 rows at most
            words[w] = v
        self.data = ids.sparkSession.sparkContext.broadcast(words)

    @staticmethod
    def bit(column: str):
        """The bit of an id, to be given to `maybe`."""
        return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(BITMAP_BITS))

    def maybe(self, bits: np.ndarray) -> np.ndarray:
        """Whether ids with these bits may be in the set; for use inside tasks."""
        return ((self.data.value[bits >> 6] >> (bits & 63)) & 1).astype(bool)

    def split(self, df: DataFrame, column: str, inside: bool, step: Callable | None = None, schema: StructType | str | None = None) -> DataFrame:
        """The rows whose id may be in the set, or those whose id is not.

        With a step, what it makes of their batches: one worker of a task does both, where two would hold memory.
        """
        name, columns = "__bit", df.columns
        keyed = df.withColumn(name, self.bit(column))

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.maybe(batch.column(name).to_numpy())
                rows = np.flatnonzero(found if inside else ~found)
                if len(rows):
                    yield batch.select(columns).take(pa.array(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from step(passed(batches)) if step else passed(batches)

        return keyed.mapInArrow(run, schema or df.schema)
