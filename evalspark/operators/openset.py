"""Open-set detection by Mahalanobis distance to the class means."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_long
from evalspark.functions.vectors import as_vector, list_column, map_vectors, matrix
from evalspark.operators.centroid import nearest_centroid
from evalspark.scaling import MODEL_BYTES, group_rank, stable

# Rows per task-sized block when products of vectors are summed.
BLOCK_ROWS = 8192


def class_moments(df: DataFrame, col: str, label: str) -> DataFrame:
    """Row count, mean and population variance per class and dimension."""
    stats = Summarizer.metrics("count", "mean", "variance").summary(as_vector(df, col))
    out = df.groupBy(label).agg(stats.alias("_s"))
    variance = vector_to_array("_s.variance")
    return out.select(
        label,
        F.col("_s.count").alias("n"),
        vector_to_array("_s.mean").alias("mean"),
        F.zip_with(
            variance, F.array_repeat(F.col("_s.count"), F.size(variance)), lambda v, n: v * (n - 1) / n
        ).alias("variance"),
    )


def pooled_variance(moments: DataFrame) -> DataFrame:
    """Within-class variance per dimension, pooled over classes by their share of rows."""
    parts = moments.select("n", F.posexplode("variance").alias("pos", "v"))
    pooled = parts.groupBy("pos").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return pooled.agg(F.transform(ordered, lambda p: p["v"]).alias("variance"))


def class_products(df: DataFrame, moments: DataFrame, col: str, label: str, id_col: str) -> DataFrame:
    """Per class: sum of outer products of the standardised rows (one row of the matrix per output
    row) and, on row 0, the sum of the fourth powers of their lengths.

    Rows are cut into hashed blocks of bounded size per class, so a large class is
    spread over many tasks; block matrices are then added row by row.
    """
    plan = moments.select(
        F.col(label).alias("_label"), "mean", "variance",
        F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("_blocks"),
    )
    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(label).alias("_label"), F.col(col).cast("array<double>").alias("_x"), F.col(id_col).alias("_id"))
    keyed = rows.join(plan.select("_label", "_blocks"), "_label")
    keyed = keyed.withColumn("_block", F.pmod(hash_long("block", F.col("_id")), F.col("_blocks")).cast("int")).drop("_id", "_blocks")
    blocks = plan.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    blocks = blocks.drop("_blocks")

    def product(data: pa.Table, stats: pa.Table) -> pa.Table:
        if not data.num_rows or not stats.num_rows:
            return pa.table({"_label": data["_label"].slice(0, 0), "i": pa.array([], pa.int32()),
                             "row": pa.array([], pa.list_(pa.float64())), "fourth": pa.array([], pa.float64())})
        mean, var = matrix(stats["mean"])[0], matrix(stats["variance"])[0]
        z = (matrix(data["_x"]) - mean) / np.where(var > 0, np.sqrt(var), 1.0)
        gram = z.T @ z
        width = len(gram)
        fourth = np.zeros(width)
        fourth[0] = ((z * z).sum(1) ** 2).sum()
        name = pa.array([data["_label"][0].as_py()] * width, data["_label"].type)
        return pa.table({"_label": name, "i": pa.array(np.arange(width, dtype=np.int32)),
                         "row": list_column(gram), "fourth": pa.array(fourth)})

    schema = f"_label {kind}, i int, row array<double>, fourth double"
    pairs = keyed.groupBy("_label", "_block").cogroup(blocks.groupBy("_label", "_block"))
    parts = pairs.applyInArrow(product, schema)
    total = vector_to_array(Summarizer.sum(array_to_vector("row")))
    return parts.groupBy("_label", "i").agg(total.alias("row"), F.sum("fourth").alias("fourth"))


def shrinkage(products: DataFrame, moments: DataFrame, label: str) -> DataFrame:
    """Ledoit-Wolf shrinkage of each class covariance, on standardised features."""
    squares = F.aggregate("row", F.lit(0.0), lambda acc, x: acc + x * x)
    sums = products.groupBy("_label").agg(
        F.sum(squares).alias("_sq"),
        F.sum("fourth").alias("_fourth"),
        F.sum(F.get("row", F.col("i"))).alias("_trace"),
        F.count(F.lit(1)).cast("double").alias("d"),
    )
    sums = sums.join(moments.select(F.col(label).alias("_label"), F.col("n").cast("double").alias("n")), "_label")
    n, d = F.col("n"), F.col("d")
    frobenius = F.col("_sq") / (n * n)
    trace = F.col("_trace") / n
    mu = trace / d
    spread = (frobenius - 2 * mu * trace + d * mu * mu) / d
    noise = F.least((F.col("_fourth") / n - frobenius) / (n * d), spread)
    share = F.when((noise == 0) | (spread == 0), 0.0).otherwise(noise / spread)
    return sums.select("_label", "n", mu.alias("mu"), share.alias("shrink"))


def pooled_covariance(
    df: DataFrame, moments: DataFrame, col: str, label: str, id_col: str, shrink: float | str | None = "auto"
) -> np.ndarray:
    """Within-class covariance, each class weighted by its share of rows.

    ``shrink`` is ``"auto"`` (Ledoit-Wolf per class), a number in [0, 1], or None.
    Only the final d x d matrix reaches the driver, after a check of its size.
    """
    products = stable(class_products(df, moments, col, label, id_col))
    stats = moments.select(F.col(label).alias("_label"), "n", "variance")
    if shrink == "auto":
        shares = shrinkage(products, moments, label).select("_label", "mu", "shrink")
    else:
        shares = stats.select("_label", F.lit(1.0).alias("mu"), F.lit(float(shrink or 0.0)).alias("shrink"))
    width = products.agg(F.max("i")).first()[0] + 1
    if width * width * 8 > MODEL_BYTES:
        raise ValueError(f"covariance of {width} dimensions is larger than the model limit")
    total = moments.agg(F.sum("n").cast("double").alias("t")).scalar()
    # The JVM scales each matrix row by sd_i * sd_j and adds the ridge on the diagonal.
    # A constant dimension keeps unit scale, so the ridge still makes it invertible.
    scale = F.transform("variance", lambda v: F.when(v > 0, v).otherwise(1.0))
    sd = F.transform(scale, lambda v: F.sqrt(v))
    scaled = products.join(stats, "_label").join(shares, "_label").withColumn("_share", F.col("n") / total)
    kept = F.col("_share") * (1 - F.col("shrink")) / F.col("n") * F.get(sd, F.col("i"))
    ridge = F.col("_share") * F.col("shrink") * F.col("mu") * F.get(scale, F.col("i"))
    rows = scaled.select(
        "i", F.zip_with("row", F.zip_with(sd, F.array_repeat(kept, F.size(sd)), lambda s, k: s * k), lambda r, s: r * s).alias("row"), ridge.alias("ridge")
    )
    pooled = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"), F.sum("ridge").alias("ridge"))
    local = pooled.orderBy("i").toArrow()
    return matrix(local["row"]) + np.diag(local["ridge"].to_numpy())


def whitening(precision: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Matrix L with ``L L^T`` equal to the precision, which may be singular, or to its diagonal only."""
    if diagonal:
        return np.diag(np.sqrt(np.diag(precision)))
    values, axes = np.linalg.eigh((precision + precision.T) / 2)
    return axes * np.sqrt(np.maximum(values, 0))


def precision_of(covariance: np.ndarray) -> np.ndarray:
    """Inverse on the axes along which the data vary; the others do not count."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    least = values.max(initial=0) * len(values) * np.finfo(float).eps
    weights = np.divide(1.0, values, out=np.zeros_like(values), where=values > least)
    return (axes * weights) @ axes.T


def quantile(df: DataFrame, value: str, id_col: str, pct: float) -> float:
    """Percentile of a column, interpolated between the two rows around it, found by rank."""
    rows = df.select(value, id_col).where(F.col(value).isNotNull())
    count = rows.count()
    if not count:
        raise ValueError("a percentile needs at least one row")
    place = pct * (count - 1)
    low = int(place)
    ranked = group_rank(rows, [], [value, id_col], largest=count)
    near = [r[0] for r in ranked.where(F.col("rank").isin(low + 1, min(low + 2, count))).orderBy("rank").select(value).collect()]
    return near[0] + (place - low) * (near[-1] - near[0])


def min_mahalanobis(
    df: DataFrame, means: DataFrame, precision: np.ndarray, col: str = "embedding", label: str = "label",
    id_col: str = "id", diagonal: bool = False, mean_col: str = "mean",
) -> DataFrame:
    """Add ``near`` (label of the closest mean) and ``d2``, the squared distance to it.

    After whitening, this is a nearest-centroid search.
    """
    root = whitening(precision, diagonal)
    white = df.withColumn("_w", map_vectors(col, lambda x: x @ root))
    centres = means.select(label, map_vectors(mean_col, lambda x: x @ root).alias("_w"))
    scored = nearest_centroid(white, centres, "_w", label, id_col, "near")
    return scored.withColumn("d2", F.col("dist") * F.col("dist")).drop("_w", "dist")


def own_mahalanobis(
    df: DataFrame, means: DataFrame, precision: np.ndarray, col: str = "embedding", label: str = "label", mean_col: str = "mean"
) -> DataFrame:
    """Add ``own_d2``, the squared distance of every row to the mean of its own class."""
    root = whitening(precision)
    centres = means.select(label, map_vectors(mean_col, lambda x: x @ root).alias("_c"))
    joined = df.withColumn("_w", map_vectors(col, lambda x: x @ root)).join(centres, label)
    squares = F.zip_with("_w", "_c", lambda a, b: (a - b) * (a - b))
    return joined.withColumn("own_d2", F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)).drop("_w", "_c")


@dataclass(frozen=True)
class OpenSet:
    """Base classifier, class means, shared precision and the distance threshold."""

    predict_known: Callable[[DataFrame], DataFrame]
    means: DataFrame
    precision: np.ndarray
    threshold: float
    col: str
    label: str
    id_col: str
    unknown: int = -1
    diagonal: bool = False

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """Known label where the distance stays within the threshold, else the unknown label."""
        known = self.predict_known(df)
        scored = min_mahalanobis(known, self.means, self.precision, self.col, self.label, self.id_col, self.diagonal)
        scored = scored.withColumn("margin", F.lit(self.threshold) - F.col("d2"))
        label = F.when(F.col("margin") >= 0, F.col(out)).otherwise(self.unknown)
        return scored.withColumn(out, label).drop("near")


def openset_fit(
    train: DataFrame,
    base: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    col: str = "embedding",
    label: str = "label",
    id_col: str = "id",
    pct: float = 0.95,
    shrink: float | str | None = "auto",
    unknown: int = -1,
    diagonal: bool = False,
) -> OpenSet:
    """Fit the base classifier and the detector.

    ``base`` takes the training rows and returns a function that adds ``y_pred``.
    The threshold is the ``pct`` percentile of the training rows' own distances.
    """
    predict_known = base(train)
    moments = stable(class_moments(train, col, label))
    covariance = pooled_covariance(train, moments, col, label, id_col, shrink)
    precision = precision_of(covariance)
    own = stable(min_mahalanobis(train, moments, precision, col, label, id_col, diagonal).select("d2", id_col))
    threshold = quantile(own, "d2", id_col, pct)
    return OpenSet(predict_known, moments, precision, threshold, col, label, id_col, unknown, diagonal)
