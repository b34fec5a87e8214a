"""Whitening of embeddings by bit-sliced scatter.

Entries become whole numbers floor(64 * c) + 1,000,000. The fit list holds each distinct vector once. A step of at most
STEP_ROWS rows shifts every dimension by its least value there and packs each bit of the shifted values, across the
rows, into 64-bit words: one plane per dimension and bit. The cross-product of two dimensions is the sum over their
planes p and q of 2**(p+q) times the number of ones in the AND of both. The shift is taken out again in whole numbers,
steps and tasks are added up exactly, and n * XX - S S^T is a whole number before it becomes a covariance.

Rows whose vector is null or empty, holds null or non-finite entries or one of 2**34 or more, or is not of the length
that most rows have (the smaller length on ties) are left out. Null or repeated ids and repeated rows are rows of their own; other columns
are ignored. Components whose variance is zero within rounding have no whitened value and give no rows, so an empty
table or one distinct vector gives none. The driver holds a few dim x dim matrices, so dim is limited to MOST_DIMS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import kept_table, table

SCALE, ORIGIN = 64, 1_000_000
# Entries below this times SCALE keep every exact sum of up to 2**40 rows within 38 digits.
LARGEST = float(2**34)
COMPONENTS = 16
STEP_ROWS, STEP_CELLS = 65_536, 1 << 22
MOST_DIMS = 2048


@dataclass(frozen=True)
class Whitening:
    """Centre (sums over n rows, less the origin), components in columns and their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, z) with z = floor(64 * c), that is x less the origin, of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)) & (F.size(c) > 0)
    return df.where(c.isNotNull() & fine).select(
        F.col(vec_id).alias("vec_id"), F.transform(c, lambda v: F.floor(v * SCALE).cast("bigint")).alias("z")
    )


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("z").flatten().to_numpy().reshape(-1, dim)


def _steps(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The rows as matrices of a bounded number of rows."""
    most, held, rows = max(1, min(STEP_ROWS, STEP_CELLS // dim)), [], 0
    for batch in batches:
        m = _matrix(batch, dim)
        while len(m):
            part, m = m[: most - rows], m[most - rows :]
            held.append(part)
            rows += len(part)
            if rows == most:
                yield np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """One row of 64-bit words per dimension and bit of the values, which are not negative."""
    rows, dim = y.shape
    words = np.zeros((dim, bits, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
        words[:, b, : packed.shape[0]] = packed.T
    return words.reshape(dim * bits, -1).view(np.uint64)


def cross_products(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column sums, matrix of cross-products) of whole numbers, exact, as Python integers."""
    rows, dim = z.shape
    low = z.min(axis=0)
    y = z - low
    bits = max(1, int(y.max()).bit_length())
    planes = bit_planes(y, bits)
    ones = np.zeros((dim * bits, dim * bits), np.int64)
    for i in range(len(planes)):
        ones[i, i:] = np.bitwise_count(planes[i] & planes[i:]).sum(axis=1, dtype=np.int64)
    ones = np.triu(ones) + np.triu(ones, 1).T
    weight = 2 ** np.arange(bits, dtype=np.int64)
    small = 2 * bits + rows.bit_length() < 62
    counts = ones.reshape(dim, bits, dim, bits)
    yy = (
        np.einsum("ipjq,p,q->ij", counts, weight, weight).astype(object)
        if small
        else sum((counts[:, p, :, q].astype(object) << (p + q) for p in range(bits) for q in range(bits)), np.zeros((dim, dim), object))
    )
    sums, low = y.sum(axis=0).astype(object), low.astype(object)
    back = np.outer(low, sums)
    return sums + rows * low, yy + back + back.T + rows * np.outer(low, low)


def _scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, cross-products) of the fit list, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for z in _steps(batches, dim):
            s, c = cross_products(z)
            n, sums, cross = n + len(z), sums + s, cross + c
        if n:
            i, j = np.triu_indices(dim)
            values = [Decimal(v) for v in (n, *sums.tolist(), *cross[i, j].tolist())]
            i, j = np.concatenate([np.full(dim + 1, -1), i]), np.concatenate([np.arange(-1, dim), j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"]
            )

    parts = fit.select("z").mapInArrow(run, "i int, j int, v decimal(38,0)")
    # dim * (dim + 3) / 2 + 1 rows, whatever the data size.
    found = {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    cross = np.zeros((dim, dim), object)
    for (i, j), v in found.items():
        if i >= 0:
            cross[i, j] = cross[j, i] = v
    return found.get((-1, -1), 0), [found.get((-1, j), 0) for j in range(dim)], cross


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Principal components of the distinct vectors `z` of a table."""
    n, sums, cross = _scatter(fit, dim)
    if not n:
        return Whitening(0, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    s = np.array(sums, dtype=object)
    centred = n * cross - np.outer(s, s)
    # Whole numbers until here; a quotient of two of them is rounded once.
    v = np.array([[int(c) / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0) * dim * np.finfo(float).eps]
    vectors = vectors[:, order]
    peak = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[peak, np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values[order], sum(int(centred[k, k]) for k in range(dim)) / (n * n))


def _transform(model: Whitening):
    """Function from a matrix of z to (n * x - S, whitened values); it holds plain arrays only."""
    n, sums, axes = model.n, model.sums, model.vectors / np.sqrt(model.variances)
    most = max((abs(s) for s in sums), default=0)

    def apply(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = n * int(np.abs(z).max(initial=0)) + most < 2**62
        off = n * z - np.array(sums, np.int64) if small else n * z.astype(object) - np.array(sums, object)
        return off, (off / n).astype(np.float64) @ axes

    return apply


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity."""
    dim, n, k, apply = len(model.sums), model.n, len(model.variances), _transform(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for z in _steps(batches, dim):
            w = apply(z)[1]
            total, cross = total + w.sum(axis=0), cross + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        i, j = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total, cross.ravel()]))], ["i", "j", "v"]
        )

    rows = fit.select("z").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for i, j, v in rows:
        if i < 0:
            mean[j] = v / n
        else:
            cov[i, j] = v / n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per row and component."""
    rows = whole_vectors(df, vec_id, vector)
    schema = rows.select(
        "vec_id",
        F.lit(1).alias("component"),
        F.lit(1).cast("bigint").alias("n"),
        F.lit(0).cast("decimal(38,0)").alias("deviation"),
        *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
    ).schema
    usual = rows.groupBy(F.size("z").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return df.sparkSession.createDataFrame([], schema)
    dim = usual["dim"]
    if dim > MOST_DIMS:
        raise ValueError(f"vectors of {dim} entries; the covariance is held by the driver for up to {MOST_DIMS}")
    rows = rows.where(F.size("z") == dim)
    fit = kept_table(rows.select("z").distinct(), "fit-list")
    model = fit_whitening(fit, dim, components)
    error, apply = identity_error(fit, model), _transform(model)
    k, n, explained = len(model.variances), model.n, model.variances / (model.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_CELLS // max(dim, 4 * k) // 4)
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, step):
                part = batch.slice(at, step)
                off, w = apply(_matrix(part, dim))
                small = off.dtype != object and int(np.abs(off).max()) ** 2 * dim < 2**63
                if small:
                    deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([Decimal(int(v)) for v in (off.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(len(w)), k))
                columns = [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w)))]
                columns += [pa.array(np.full(len(row), n)), deviation.take(row), pa.array(w.ravel())]
                columns += [pa.array(np.tile(explained, len(w))), pa.array(np.full(len(row), error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op12_bit_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened embeddings; a deviation beyond 64 bits is an error, not a wrong number."""
    found = whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))
