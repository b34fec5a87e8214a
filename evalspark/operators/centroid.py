"""Nearest-centroid classification on centred, normalised vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.vectors import center_and_normalize, fit_center, matrix, pool_mean
from evalspark.operators.neighbours import knn_join, nearest_rows
from evalspark.scaling import MODEL_BYTES, setting, stable


def _nearest_udf(points: np.ndarray, labels: pa.Array, kind: str):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(f"struct<label:{kind},dist:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = matrix(vectors) if len(vectors) else np.zeros((0, points.shape[1]))
        pos, dist = np.full(len(x), -1), np.full(len(x), np.nan)
        rows, cols, gaps = nearest_rows(x, points, 1)
        pos[rows], dist[rows] = cols, gaps
        none = pos < 0
        return pa.StructArray.from_arrays(
            [labels.take(pa.array(pos, mask=none)), pa.array(dist, mask=none)], ["label", "dist"]
        )

    return nearest


def model_bytes(centroids: DataFrame, col: str) -> int:
    """Size of a centroid table as a dense matrix of doubles."""
    row = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    return int(row["n"]) * int(row["d"] or 0) * 8


def nearest_centroid(
    df: DataFrame, centroids: DataFrame, col: str = "embedding", label: str = "label", id_col: str = "id", out: str = "y_pred"
) -> DataFrame:
    """Add the label of the nearest centroid and the distance ``dist``; the lowest label wins a tie.

    Both are null for a vector with a component that is not finite.

    A centroid table below the model size limit goes to every task and the rows are
    scored where they are. A larger one is joined as a 1-nearest-neighbour search.
    """
    limit = setting(df.sparkSession, "modelBytes", MODEL_BYTES)
    table = centroids.select(F.col(label).alias("_label"), F.col(col).alias("_centre"))
    if model_bytes(table, "_centre") <= limit:
        local = table.orderBy("_label").toArrow()
        kind = centroids.schema[label].dataType.simpleString()
        nearest = _nearest_udf(matrix(local["_centre"]), local["_label"].combine_chunks(), kind)
        scored = df.withColumn("_near", nearest(F.col(col)))
        return scored.withColumns({out: F.col("_near.label"), "dist": F.col("_near.dist")}).drop("_near")
    refs = table.select(F.col("_label").alias("rid"), F.col("_centre").alias(col))
    near = knn_join(df, refs, 1, id_col, col, ref_id="rid")
    near = near.select(F.col("qid").alias(id_col), F.col("rid").alias(out), "dist")
    return df.join(near, id_col, "left")


@dataclass(frozen=True)
class SimpleShot:
    """Training mean and one centroid per class of the centred unit vectors."""

    mean: StandardScalerModel
    centroids: DataFrame
    col: str = "embedding"
    label: str = "label"

    def predict(self, test: DataFrame, id_col: str = "id", out: str = "y_pred") -> DataFrame:
        """Add the class of the nearest centroid."""
        unit = center_and_normalize(test, self.col, self.mean, "_unit")
        centres = self.centroids.withColumnRenamed(self.col, "_unit")
        scored = nearest_centroid(unit, centres, "_unit", self.label, id_col, out)
        return scored.drop("_unit")


def simpleshot_fit(train: DataFrame, col: str = "embedding", label: str = "label") -> SimpleShot:
    """Centre by the training mean, scale to unit length, average per class."""
    mean = fit_center(train, col)
    unit = center_and_normalize(train.select(label, col), col, mean)
    # The centroids are read for their size and again for scoring.
    return SimpleShot(mean, stable(pool_mean(unit, [label], col)), col, label)


def centroid_table(df: DataFrame, col: str, label: str) -> DataFrame:
    """Mean vector and row count per class."""
    return pool_mean(df, [label], col, F.count(F.lit(1)).alias("n"))


def pool_observations(df: DataFrame, key: str, col: str, label: str, order: str) -> DataFrame:
    """Mean vector per observation with the label of its first row."""
    return pool_mean(df, [key], col, F.min_by(label, order).alias(label))
