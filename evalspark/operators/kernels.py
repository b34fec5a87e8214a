"""Kernel machines as linear ones: features from the kernel with a bounded number of landmark rows.

With landmarks Z and K(Z, Z) = U D U^T, a row x becomes K(x, Z) U D^(-1/2). Dot products of these features are the kernel
itself between landmarks, and its best approximation from them elsewhere; with every row a landmark nothing is lost. A
kernel that is not positive (sigmoid) keeps its positive part. Rows are mapped on executors, one by one, so any linear
fit takes them; the driver holds the landmarks and one matrix over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_long
from evalspark.functions.vectors import map_vectors
from evalspark.scaling import MODEL_BYTES, setting

LANDMARKS = 256


def kernel_matrix(x: np.ndarray, z: np.ndarray, kind: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    """Kernel values of all rows of x with all rows of z."""
    if kind == "rbf":
        apart = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * x @ z.T
        return np.exp(-gamma * np.maximum(apart, 0))
    if kind == "linear":
        return x @ z.T
    if kind == "poly":
        return (gamma * x @ z.T + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * x @ z.T + coef0)
    raise ValueError(f"unknown kernel {kind!r}")


@dataclass(frozen=True)
class LandmarkMap:
    """Landmarks and the matrix that turns kernel values with them into features; calling it adds a column."""

    landmarks: np.ndarray
    root: np.ndarray
    kind: str
    gamma: float
    degree: int
    coef0: float
    col: str

    def __call__(self, df: DataFrame, out: str = "features") -> DataFrame:
        landmarks, root, options = self.landmarks, self.root, (self.kind, self.gamma, self.degree, self.coef0)
        return df.withColumn(out, map_vectors(self.col, lambda x: kernel_matrix(x, landmarks, *options) @ root))


def landmark_map(
    train: DataFrame, kind: str, gamma: float, count: int = LANDMARKS, col: str = "embedding", id_col: str = "id", seed: int = 17,
    degree: int = 3, coef0: float = 0.0,
) -> LandmarkMap:
    """Map with the ``count`` rows of lowest hash as landmarks, all rows if there are fewer."""
    chosen = train.select(F.col(col).cast("array<double>").alias("x"), hash_long(seed, "landmark", F.col(id_col)).alias("h"), F.col(id_col).alias("i"))
    z = np.array([r["x"] for r in chosen.orderBy("h", "i").limit(count).collect()])
    if 8 * (z.size + 2 * len(z) ** 2) > setting(train.sparkSession, "modelBytes", MODEL_BYTES):
        raise ValueError("the landmarks exceed spark.evalspark.modelBytes")
    gram = kernel_matrix(z, z, kind, gamma, degree, coef0)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > max(values.max(initial=0), 0) * len(values) * np.finfo(float).eps
    return LandmarkMap(z, axes[:, kept] / np.sqrt(values[kept]), kind, gamma, degree, coef0, col)
