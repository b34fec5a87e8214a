"""Linear classifiers on stored vectors, fitted jointly (``joint``) with free intercepts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import BITS, hash_long
from evalspark.functions.vectors import l2_normalize, layer_norm, map_vectors, pool_mean
from evalspark.operators import joint
from evalspark.operators.metrics import macro_f1
from evalspark.operators.tables import label_codes
from evalspark.scaling import MODEL_BYTES, setting, stable


def _folds(col: str, folds: int) -> Column:
    """Fold of a row by its content, so that equal vectors stay together."""
    return F.pmod(F.xxhash64(F.col(col).cast("array<double>")), F.lit(folds)).cast("int")


def _check_size(spark, numbers: int) -> None:
    if 8 * numbers > setting(spark, "modelBytes", MODEL_BYTES):
        raise ValueError(f"{numbers} coefficients exceed spark.evalspark.modelBytes")


@dataclass(frozen=True)
class Head:
    """Soft-max head on scaled features; calling it adds ``y_pred`` and ``probability`` (one entry per label, in order)."""

    col: str
    prepare: Callable[[Column], Column]
    labels: list
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    strength: float | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        center, spread, weights = self.center, self.spread, self.weights

        def probability(x: np.ndarray) -> np.ndarray:
            return joint.softmax((x - center) / spread @ weights[:-1] + weights[-1])

        out = df.withColumn("_f", self.prepare(F.col(self.col))).withColumn("probability", map_vectors("_f", probability))
        first = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("y_pred", F.element_at(F.array(*map(F.lit, self.labels)), first)).drop("_f")


def _coded(train: DataFrame, label: str, x: Column, fold: Column) -> tuple[DataFrame, list]:
    """Rows (x, y, fold) with labels as codes, and the labels in order of their codes."""
    codes = stable(label_codes(train, label))
    labels = [r[label] for r in codes.orderBy("code").select(label).collect()]
    rows = train.join(codes.select(label, F.col("code").cast("int").alias("y")), label)
    return stable(rows.select(x.cast("array<double>").alias("x"), "y", fold.cast("int").alias("fold"))), labels


def linear_probe(
    train: DataFrame, col: str = "embedding", label: str = "label", weight_decay: float = 1e-2, max_iter: int = 1000
) -> Head:
    """Soft-max head on layer-normalised vectors; the penalty is weight_decay / 2 times the squared coefficients."""
    rows, labels = _coded(train, label, layer_norm(F.col(col)), F.lit(0))
    n, width = rows.count(), len(rows.select("x").first()["x"])
    group = {"center": np.zeros(width), "spread": np.ones(width), "fold": -1, "weights": np.ones(len(labels)), "models": slice(0, 1)}
    _check_size(train.sparkSession, 2 * joint.MEMORY * (width + 1) * len(labels))
    w = joint.minimize(
        rows, joint.log_loss_kernel([group], len(labels)), _penalties(width, len(labels), np.array([weight_decay])),
        np.zeros((1, (width + 1) * len(labels))), np.array([float(n)]), max_iter,
    )
    return Head(col, layer_norm, labels, group["center"], group["spread"], w[0].reshape(width + 1, -1))


def _penalties(width: int, classes: int, strength: np.ndarray) -> np.ndarray:
    """Penalty of every coefficient of (features and intercept) x classes; intercepts are free."""
    free = np.concatenate([np.ones(width * classes), np.zeros(classes)])
    return strength[:, None] * free


def log_uniform(low: float, high: float, n: int, seed: int, tag: str, spark) -> list[float]:
    """n seeded draws, uniform on the log scale."""
    draws = spark.range(n).select((hash_long(seed, tag, F.col("id")) / F.lit(float(2**BITS))).alias("u")).collect()
    return [math.exp(math.log(low) + row["u"] * (math.log(high) - math.log(low))) for row in draws]


def search_logreg(
    train: DataFrame,
    col: str = "embedding",
    label: str = "label",
    n_iter: int = 30,
    folds: int = 5,
    seed: int = 17,
    max_iter: int = 1000,
) -> Head:
    """Standardised logistic regression with balanced class weights; the penalty is searched.

    The strength C is drawn log-uniformly from [1e-3, 10] and chosen by cross-validated macro F1; a model minimises C
    times the weighted loss plus half the squared coefficients. The models of all draws and folds are one joint fit.
    """
    rows, labels = _coded(train, label, F.col(col), _folds(col, folds))
    classes, width = len(labels), len(rows.select("x").first()["x"])
    strengths = np.array(log_uniform(1e-3, 1e1, n_iter, seed, "C", train.sparkSession))
    _check_size(train.sparkSession, 2 * joint.MEMORY * n_iter * folds * (width + 1) * classes)
    mean, spread, n = (part[0] for part in joint.moments(rows, width, folds))
    counted = np.zeros((folds, classes))
    for r in rows.groupBy("fold", "y").count().collect():
        counted[r["fold"], r["y"]] = r["count"]

    def group(f: int, models: slice) -> dict:
        size = counted.sum(axis=0) - (counted[f] if f < folds else 0)
        weights = np.divide(n[f], classes * size, out=np.zeros(classes), where=size > 0)
        return {"center": mean[f], "spread": spread[f], "fold": f, "weights": weights, "models": models}

    def fit(groups: list[dict], strength: np.ndarray, size: np.ndarray) -> np.ndarray:
        start = np.zeros((len(strength), (width + 1) * classes))
        kernel = joint.log_loss_kernel(groups, classes)
        return joint.minimize(rows, kernel, _penalties(width, classes, 1 / (strength * size)), start, size, max_iter)

    groups = [group(f, slice(f * n_iter, (f + 1) * n_iter)) for f in range(folds)]
    w = fit(groups, np.tile(strengths, folds), np.repeat(n[:folds], n_iter))
    cells = joint.held_out_cells(rows, groups, w, classes)
    scores = np.zeros((folds, n_iter))
    for r in macro_f1(cells, ["model"], "w", present_only=True).collect():
        scores[divmod(r["model"], n_iter)] = r["value"]
    best = strengths[int(np.round(scores.mean(axis=0), 12).argmax())]
    last = group(folds, slice(0, 1))
    w = fit([last], np.array([best]), np.array([n[folds]]))
    return Head(col, lambda c: c.cast("array<double>"), labels, last["center"], last["spread"], w[0].reshape(width + 1, -1), float(best))


def _center_by_task(df: DataFrame, train: DataFrame, task: str, col: str) -> DataFrame:
    """Subtract each task's training mean and scale to unit length."""
    means = pool_mean(train.select(task, col), [task], col).withColumnRenamed(col, "_mean")
    moved = df.join(means, task).withColumn(col, F.zip_with(F.col(col).cast("array<double>"), "_mean", lambda x, m: x - m))
    return l2_normalize(moved.drop("_mean"), col)


@dataclass(frozen=True)
class Machines:
    """One support vector machine per task: scaling, coefficients, strength C and duality gap over the objective."""

    task: str
    col: str
    codes: DataFrame
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    strengths: np.ndarray
    gaps: np.ndarray

    def __call__(self, df: DataFrame) -> DataFrame:
        center, spread, weights = self.center, self.spread, self.weights

        def margin(x: np.ndarray) -> np.ndarray:
            t = x[:, 0].astype(int)
            return (((x[:, 1:] - center[t]) / spread[t]) * weights[t, :-1]).sum(axis=1, keepdims=True) + weights[t, -1:]

        coded = df.join(self.codes.select(self.task, F.col("code").cast("double").alias("_t")), self.task)
        coded = coded.withColumn("_f", F.concat(F.array("_t"), F.col(self.col).cast("array<double>")))
        out = coded.withColumn("_m", map_vectors("_f", margin))
        return out.withColumn("y_pred", (F.get("_m", F.lit(0)) > 0).cast("int")).drop("_t", "_f", "_m")

    def report(self) -> DataFrame:
        """(task, c, gap) of every task."""
        spark = self.codes.sparkSession
        rows = [(k, float(c), float(g)) for k, (c, g) in enumerate(zip(self.strengths, self.gaps, strict=True))]
        found = spark.createDataFrame(rows, "code bigint, c double, gap double")
        return self.codes.join(found, "code").select(self.task, "c", "gap")


# Widths of the smoothed corner, each fit starting from the one before.
BENDS = (0.5, 0.1, 0.02)
# Largest entry of the gradient, per row and unit of C, of the models that are only compared on held-out rows.
SEARCH_TOLERANCE = 1e-4


def fit_svms(
    train: DataFrame, task: str = "task", label: str = "label", col: str = "embedding", strengths: list[float] = (1.0,),
    folds: int = 5, scale: bool = True, max_iter: int = 1000,
) -> Machines:
    """A linear support vector machine per task; with several strengths C each task takes the one of best accuracy.

    The models of all tasks, folds and strengths are joint fits, cut into slices of tasks whose coefficients fit
    ``spark.evalspark.modelBytes``. With ``scale`` features are standardised on each training set.
    """
    spark = train.sparkSession
    codes = stable(label_codes(train, task))
    total, strengths = codes.count(), np.array(strengths, float)
    rows = train.join(codes.select(task, F.col("code").cast("int").alias("task_code")), task)
    rows = stable(rows.select(
        F.col(col).cast("array<double>").alias("x"), (F.col(label) * 2 - 1).cast("double").alias("y"), F.col("task_code").alias("task"),
        _folds(col, folds).alias("fold"),
    ))
    width = len(rows.select("x").first()["x"])
    searched = folds if len(strengths) > 1 else 0
    # Coefficients, gradients and history of one task, twice over for what is built beside them.
    per_task = 8 * 2 * (2 * joint.MEMORY + 6) * (width + 1) * max(searched * len(strengths), 1)
    step = max(1, setting(spark, "modelBytes", MODEL_BYTES) // per_task)
    parts = []
    for first in range(0, total, step):
        own = rows if step >= total else rows.where(F.col("task").between(first, first + step - 1)).withColumn("task", F.col("task") - first)
        parts.append(_fit_slice(own, min(step, total - first), width, strengths, folds, searched, scale, max_iter))
    center, spread, weights, best, gaps = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Machines(task, col, codes, center, spread, weights, best, gaps)


def _fit_slice(rows, tasks, width, strengths, folds, searched, scale, max_iter):
    mean, spread, n = joint.moments(rows, width, folds, tasks)
    if not scale:
        mean, spread = np.zeros_like(mean), np.ones_like(spread)

    def fit(center, spread, used, c, bends, tolerance):
        """c is (tasks, folds, strengths) and used the rows of (tasks, folds); the objective is divided by both."""
        size = np.maximum(np.broadcast_to(used[:, :, None], c.shape), 1).ravel()
        w = np.zeros((c.size, width + 1))
        for bend in bends:
            kernel = joint.hinge_kernel(center, spread, c.shape[2], bend)
            w = joint.minimize(rows, kernel, _penalties(width, 1, 1 / (c.ravel() * size)), w, size, max_iter, tolerance)
        return w.reshape(*c.shape, width + 1)

    best = np.full(tasks, strengths[0])
    if searched:
        center, wide = mean[:, :folds], spread[:, :folds]
        w = fit(center, wide, n[:, :folds], np.broadcast_to(strengths, (tasks, folds, len(strengths))), BENDS[1:2], SEARCH_TOLERANCE)

        def hits(c):
            out = np.zeros((tasks, folds, len(strengths)))
            for t, f, x, y in joint.task_rows(c, center, wide, held_out=True):
                out[t, f] = ((x @ w[t, f].T > 0) == (y > 0)).sum(axis=0)
            return out

        held = (n[:, folds :] - n[:, :folds])[:, :, None]
        share = joint.added(rows, hits).reshape(tasks, folds, -1) / np.maximum(held, 1)
        best = strengths[np.round(share.mean(axis=1), 12).argmax(axis=1)]
    # A fold that no row has: all rows are used.
    center, wide = mean[:, folds:], spread[:, folds:]
    rows = rows.withColumn("fold", F.lit(-1))
    w = fit(center, wide, n[:, folds:], best[:, None, None], BENDS, 1e-7)[:, 0, 0]

    def dual(c):
        """Per task: hinge loss, sum of multipliers, and multipliers times label times features and constant."""
        out = np.zeros((tasks, width + 3))
        for t, _, x, y in joint.task_rows(c, center, wide):
            below = 1 - y * (x @ w[t][:, None])
            push = np.clip(below / BENDS[-1], 0, 1)
            out[t] = [np.maximum(below, 0).sum(), push.sum(), *((push * y).T @ x)[0]]
        return out

    d = joint.added(rows, dual).reshape(tasks, -1) * best[:, None]
    primal = (w[:, :-1] ** 2).sum(axis=1) / 2 + d[:, 0]
    # Multipliers lie in [0, C]; the dual needs their sum by label to be zero, which the free intercept sees to.
    gaps = (primal - d[:, 1] + (d[:, 2:-1] ** 2).sum(axis=1) / 2) / np.maximum(primal, 1e-12) + np.abs(d[:, -1]) / np.maximum(d[:, 1], 1e-12)
    return center[:, 0], wide[:, 0], w, best, gaps


def svm_by_task(
    train: DataFrame, test: DataFrame, task: str = "task", label: str = "label", col: str = "embedding",
    c: float = 1.0, max_iter: int = 1000,
) -> DataFrame:
    """Linear support vector machine per task on centred unit vectors; adds ``y_pred``."""
    centred = _center_by_task(train, train, task, col)
    return fit_svms(centred, task, label, col, [c], scale=False, max_iter=max_iter)(_center_by_task(test, train, task, col))


def search_svm_by_task(
    train: DataFrame, task: str = "task", label: str = "label", col: str = "embedding", n_iter: int = 100, folds: int = 5,
    seed: int = 42, max_iter: int = 1000,
) -> Machines:
    """Standardised linear machine per task, its C searched among log-uniform draws from [1e-3, 10]."""
    strengths = log_uniform(1e-3, 1e1, n_iter, seed, "C", train.sparkSession)
    return fit_svms(train, task, label, col, strengths, folds, max_iter=max_iter)


def multilabel_probe(
    train: DataFrame, col: str = "embedding", labels: str = "y", penalty: float = 1e-3, max_iter: int = 1000
) -> Callable[[DataFrame], DataFrame]:
    """One linear logistic output per trait, all fitted jointly; the result adds ``scores`` (probability per trait)."""
    traits = train.select(F.max(F.size(labels)).alias("k")).first()["k"]
    y = F.array(*[F.get(labels, F.lit(j)).cast("double") for j in range(traits)])
    rows = stable(train.select(F.col(col).cast("array<double>").alias("x"), y.alias("y")))
    width = len(rows.select("x").first()["x"])
    _check_size(train.sparkSession, 2 * joint.MEMORY * (width + 1) * traits)
    known = joint.added(rows, lambda c: (~np.isnan(c["y"])).sum(axis=0))
    weights = joint.minimize(
        rows, joint.trait_kernel, _penalties(width, 1, np.full(traits, penalty)), np.zeros((traits, width + 1)), np.maximum(known, 1.0), max_iter
    )

    def predict(df: DataFrame) -> DataFrame:
        def score(x):
            return 1 / (1 + np.exp(-(x @ weights[:, :-1].T + weights[:, -1])))

        return df.withColumn("scores", map_vectors(col, score))

    return predict


def multilabel_decide(df: DataFrame, threshold: float = 0.5, scores: str = "scores", labels: str = "y_true") -> DataFrame:
    """Trait predictions above the threshold, and the share of traits predicted right."""
    pred = F.transform(scores, lambda s: (s > threshold).cast("int"))
    out = df.withColumn("y_pred", pred)
    right = F.aggregate(
        F.zip_with("y_pred", labels, lambda p, t: (p == t).cast("double")), F.lit(0.0), lambda acc, hit: acc + hit
    )
    return out.withColumn("score", right / F.size(labels))
