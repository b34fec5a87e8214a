"""Vector helpers. Columns are arrays of numbers; the work runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Normalizer, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def as_vector(df: DataFrame, col: str) -> Column:
    """The column as an ML vector of doubles."""
    if isinstance(df.schema[col].dataType, ArrayType):
        return array_to_vector(F.col(col).cast("array<double>"))
    return F.col(col)


def l2_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Scale each vector to unit Euclidean length."""
    scaled = Normalizer(inputCol="_tmp_vec", outputCol="_tmp_unit", p=2.0).transform(
        df.withColumn("_tmp_vec", as_vector(df, col))
    )
    return scaled.withColumn(out or col, vector_to_array("_tmp_unit")).drop("_tmp_vec", "_tmp_unit")


def fit_center(df: DataFrame, col: str) -> StandardScalerModel:
    """Column means of the vectors, ready to be subtracted from other rows."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_tmp_vec", outputCol="_tmp_centred")
    return scaler.fit(df.select(as_vector(df, col).alias("_tmp_vec")))


def center(df: DataFrame, col: str, model: StandardScalerModel, out: str | None = None) -> DataFrame:
    """Subtract the fitted means."""
    moved = model.transform(df.withColumn("_tmp_vec", as_vector(df, col)))
    return moved.withColumn(out or col, vector_to_array("_tmp_centred")).drop("_tmp_vec", "_tmp_centred")


def center_and_normalize(df: DataFrame, col: str, model: StandardScalerModel, out: str | None = None) -> DataFrame:
    """Subtract the fitted means, then scale to unit length."""
    moved = model.transform(df.withColumn("_tmp_vec", as_vector(df, col)))
    unit = Normalizer(inputCol="_tmp_centred", outputCol="_tmp_unit", p=2.0).transform(moved)
    return unit.withColumn(out or col, vector_to_array("_tmp_unit")).drop("_tmp_vec", "_tmp_centred", "_tmp_unit")


def layer_norm(col: Column, eps: float = 1e-5) -> Column:
    """Subtract the mean of the row's values, then divide by the deviation of what is left."""
    values = col.cast("array<double>")
    size = F.size(values)

    def total(x: Column, of) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + of(v))

    def scaled(centred: Column) -> Column:
        deviation = F.sqrt(total(centred, lambda v: v * v) / size + eps)
        return F.zip_with(centred, F.array_repeat(deviation, size), lambda v, d: v / d)

    # An array of one element binds a value, so it is computed once per row.
    centred = F.zip_with(values, F.array_repeat(total(values, lambda v: v) / size, size), lambda v, m: v - m)
    return F.get(F.transform(F.array(centred), scaled), F.lit(0))


def first_token(patches: Column) -> Column:
    """Vector of the first patch."""
    return F.get(patches, F.lit(0))


def max_patch(patches: Column) -> Column:
    """Largest value per dimension over all patches."""
    return F.aggregate(
        F.slice(patches, F.lit(2), F.greatest(F.size(patches) - 1, F.lit(0))),
        F.get(patches, F.lit(0)),
        lambda acc, patch: F.zip_with(acc, patch, lambda a, b: F.greatest(a, b)),
    )


def mean_patch(patches: Column) -> Column:
    """Mean per dimension over all patches."""
    size = F.size(patches)
    return F.aggregate(
        F.slice(patches, F.lit(2), F.greatest(size - 1, F.lit(0))),
        F.get(patches, F.lit(0)),
        lambda acc, patch: F.zip_with(acc, patch, lambda a, b: a + b),
        lambda acc: F.zip_with(acc, F.array_repeat(size, F.size(acc)), lambda a, n: a / n),
    )


def mean_then_max(patches: Column, depth: int) -> Column:
    """Split the patches into ``depth`` equal runs, average them, then take the maximum."""
    run = (F.size(patches) / depth).cast("int")
    return max_patch(
        F.transform(
            F.sequence(F.lit(1), run),
            lambda i: mean_patch(
                F.transform(
                    F.sequence(F.lit(0), F.lit(depth - 1)),
                    lambda d: F.get(patches, d * run + i - 1),
                )
            ),
        )
    )


def pool_mean(df: DataFrame, keys: list[str], col: str, *carry: Column) -> DataFrame:
    """Mean vector per group, with extra aggregates in ``carry``."""
    mean = vector_to_array(Summarizer.mean(as_vector(df, col)))
    return df.groupBy(*keys).agg(mean.alias(col), *carry)


def pool_max(df: DataFrame, keys: list[str], col: str, *carry: Column) -> DataFrame:
    """Largest value per dimension and group, with extra aggregates in ``carry``."""
    top = vector_to_array(Summarizer.max(as_vector(df, col)))
    return df.groupBy(*keys).agg(top.alias(col), *carry)


def column_moments(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Per-dimension mean and population deviation, with the row count."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(as_vector(df, col))
    out = df.groupBy(*(keys or [])).agg(stats.alias("_s"))
    return out.select(
        *(keys or []),
        F.col("_s.count").alias("n"),
        vector_to_array("_s.mean").alias("mean"),
        F.zip_with(
            vector_to_array("_s.variance"),
            F.array_repeat(F.col("_s.count"), F.size(vector_to_array("_s.variance"))),
            lambda v, n: F.sqrt(v * (n - 1) / n),
        ).alias("std"),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column as a 2-d array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vectors must not be null")
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def list_column(values: np.ndarray) -> pa.Array:
    """2-d array as an Arrow list column."""
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def map_vectors(col: str, fn: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Apply a function on 2-d arrays to a vector column, one Arrow batch at a time."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def apply(values: pa.Array) -> pa.Array:
        return list_column(np.asarray(fn(matrix(values)), dtype=np.float64))

    return apply(F.col(col))
