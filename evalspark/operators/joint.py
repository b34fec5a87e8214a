"""Many regularised linear models fitted together.

All models of a family share each pass over the rows: a task turns its rows into one loss and one gradient per model
(matrix products over all models at once), partial sums are added in two steps, and the driver, which holds only
coefficients, takes a limited-memory quasi-Newton step for every model that has not converged. Intercepts are never
penalised. A family is cut into slices whose coefficients and history fit ``spark.evalspark.modelBytes``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of steps and gradient changes that a model remembers.
MEMORY = 12
TOLERANCE = 1e-8

# Takes the columns of a batch and coefficients (models, width); returns losses (models,) and gradients (models, width).
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of an array column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {
        name: matrix(column) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)
        for name, column in zip(batch.schema.names, batch.columns, strict=True)
    }


def added(rows: DataFrame, compute: Callable[[dict[str, np.ndarray]], np.ndarray], step: int = 4096) -> np.ndarray:
    """Sum over all rows of an array that ``compute`` makes of up to ``step`` rows; added on executors, then on the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                found = compute(columns_of(batch.slice(k, step)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()])], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("sums"):
                found = np.frombuffer(value.as_buffer(), float)
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    sums = rows.mapInArrow(partial, "sums binary")
    parts = rows.rdd.getNumPartitions()
    if parts > 16:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(again, "sums binary")
    found = [np.frombuffer(r["sums"], float) for r in sums.collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)


def minimize(
    rows: DataFrame, kernel: Kernel, penalty: np.ndarray, start: np.ndarray, scale: np.ndarray, max_iter: int = 1000, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Coefficients (models, width) that minimise sum(loss) / scale + sum(penalty * w**2) / 2 for every model.

    ``penalty`` has the shape of the coefficients, with zeros for those that are free.
    """
    models, width = start.shape

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = added(rows, lambda c: np.concatenate([part.ravel() for part in kernel(c, w)]))
        loss, slope = flat[:models] / scale, flat[models:].reshape(models, width) / scale[:, None]
        return loss + (penalty * w * w).sum(axis=1) / 2, slope + penalty * w

    w = start.copy()
    f, g = value(w)
    past = _Memory(models, width)
    length, heading = np.ones(models), past.direction(g)
    live = np.abs(g).max(axis=1) > tolerance
    for _ in range(max_iter):
        if not live.any():
            break
        # Every model tries its own step in the same pass.
        tried = np.where(live[:, None], w + length[:, None] * heading, w)
        f_new, g_new = value(tried)
        slope = (g * heading).sum(axis=1)
        good = live & (f_new <= f + 1e-4 * length * slope + 1e-14 * np.abs(f))
        past.add(good, tried - w, g_new - g)
        w[good], f[good], g[good], length[good] = tried[good], f_new[good], g_new[good], 1.0
        bad = live & ~good
        length[bad] /= 2
        # Start again from the plain gradient, and give up if that was tried.
        stuck = bad & (length < 1e-10)
        live &= ~(stuck & past.empty())
        past.forget(stuck)
        length[stuck] = 1.0
        live[good] = np.abs(g[good]).max(axis=1) > tolerance
        moved = good | stuck
        heading[moved] = past.direction(g)[moved]
    return w


class _Memory:
    """Last steps and gradient changes of every model, oldest first; unused places have no weight."""

    def __init__(self, models: int, width: int):
        self.steps, self.changes = np.zeros((MEMORY, models, width)), np.zeros((MEMORY, models, width))
        self.weight = np.zeros((MEMORY, models))

    def add(self, models: np.ndarray, step: np.ndarray, change: np.ndarray) -> None:
        inner = (step * change).sum(axis=1)
        at = np.flatnonzero(models & (inner > 1e-14 * (change * change).sum(axis=1)))
        for held, new in ((self.steps, step), (self.changes, change), (self.weight, 1 / np.where(inner > 0, inner, 1))):
            held[:-1, at] = held[1:, at]
            held[-1, at] = new[at]

    def forget(self, models: np.ndarray) -> None:
        self.weight[:, models] = 0

    def empty(self) -> np.ndarray:
        return self.weight[-1] == 0

    def direction(self, g: np.ndarray) -> np.ndarray:
        """Two-loop recursion; without memory a gradient step of unit length at most."""
        q, used = g.copy(), np.zeros_like(self.weight)
        for k in range(MEMORY - 1, -1, -1):
            used[k] = self.weight[k] * (self.steps[k] * q).sum(axis=1)
            q -= used[k][:, None] * self.changes[k]
        size = (self.changes[-1] ** 2).sum(axis=1) * self.weight[-1]
        first = 1 / np.maximum(1.0, np.linalg.norm(g, axis=1))
        q *= np.where(size > 0, 1 / np.where(size > 0, size, 1), first)[:, None]
        for k in range(MEMORY):
            back = self.weight[k] * (self.changes[k] * q).sum(axis=1)
            q += (used[k] - back)[:, None] * self.steps[k]
        return -q


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def log_loss_kernel(groups: list[dict], classes: int) -> Kernel:
    """Multinomial loss. A group has a ``center`` and a ``spread`` of the features ``x``, a ``fold`` whose rows it leaves
    out, ``weights`` per class, and ``models``, the slice of the coefficients that belong to it."""

    def kernel(c: dict[str, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, slope = np.zeros(len(w)), np.zeros_like(w)
        for group in groups:
            used = c["fold"] != group["fold"]
            if not used.any():
                continue
            x = (c["x"][used] - group["center"]) / group["spread"]
            x, y = np.concatenate([x, np.ones((len(x), 1))], axis=1), c["y"][used].astype(int)
            own = w[group["models"]]
            own = own.reshape(len(own), -1, classes)
            p = softmax(np.einsum("nd,mdc->mnc", x, own, optimize=True))
            weight, row = group["weights"][y], np.arange(len(y))
            loss[group["models"]] = -(np.log(np.maximum(p[:, row, y], 1e-300)) * weight).sum(axis=1)
            p[:, row, y] -= 1
            slope[group["models"]] = np.einsum("nd,mnc->mdc", x, p * weight[:, None], optimize=True).reshape(len(own), -1)
        return loss, slope

    return kernel


def trait_kernel(c: dict[str, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary loss of one model per trait: features ``x``, an array ``y`` of 0 and 1 with one entry per model; nan is left out."""
    x, y = np.concatenate([c["x"], np.ones((len(c["x"]), 1))], axis=1), c["y"]
    known = ~np.isnan(y)
    z = x @ w.T
    loss = np.where(known, np.logaddexp(0, z) - np.where(known, y, 0) * z, 0)
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return loss.sum(axis=0), np.where(known, p - y, 0).T @ x


def hinge_kernel(center: np.ndarray, spread: np.ndarray, strengths: int, bend: float) -> Kernel:
    """Smoothed hinge loss of (task, fold, strength) models on features ``x``, ``y`` of -1 and 1, ``task`` and ``fold``.

    ``center`` and ``spread`` are (tasks, folds, width); a model of fold f leaves the rows of that fold out. The corner
    of the hinge is a parabola of width ``bend``.
    """
    tasks, folds, width = center.shape

    def kernel(c: dict[str, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, slope = np.zeros((tasks, folds, strengths)), np.zeros((tasks, folds, strengths, width + 1))
        every = w.reshape(slope.shape)
        for t, f, x, y in task_rows(c, center, spread):
            below = 1 - y * (x @ every[t, f].T)
            push = np.clip(below / bend, 0, 1)
            loss[t, f] = np.where(push < 1, push * below / 2, below - bend / 2).sum(axis=0)
            slope[t, f] = -(push * y).T @ x
        return loss.ravel(), slope.reshape(w.shape)

    return kernel


def task_rows(c: dict[str, np.ndarray], center: np.ndarray, spread: np.ndarray, held_out: bool = False) -> Iterator[tuple]:
    """(task, fold, scaled features with a constant, labels) of the rows inside, or only those outside, each training set."""
    for t in np.unique(c["task"]).tolist():
        for f in range(center.shape[1]):
            used = (c["task"] == t) & ((c["fold"] == f) == held_out)
            if used.any():
                x = (c["x"][used] - center[t, f]) / spread[t, f]
                yield int(t), f, np.concatenate([x, np.ones((len(x), 1))], axis=1), c["y"][used][:, None]


def moments(rows: DataFrame, width: int, folds: int, tasks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation (tasks, folds + 1, width) and rows (tasks, folds + 1) of ``x`` outside each fold, last over all."""

    def parts(c: dict[str, np.ndarray], value: Callable[[int, int], np.ndarray], shape: tuple) -> np.ndarray:
        out = np.zeros(shape)
        for t in np.unique(c["task"]).tolist() if tasks > 1 else [0]:
            mine = c["task"] == t if tasks > 1 else np.ones(len(c["x"]), bool)
            for f in range(shape[1]):
                out[int(t), f] = value(mine & (c["fold"] != f), (int(t), f))
        return out

    def sums(c: dict[str, np.ndarray]) -> np.ndarray:
        x = np.concatenate([np.ones((len(c["x"]), 1)), c["x"]], axis=1)
        return parts(c, lambda used, at: x[used].sum(axis=0), (tasks, folds + 1, width + 1))

    s = added(rows, sums).reshape(tasks, folds + 1, width + 1)
    n = s[:, :, 0]
    mean = s[:, :, 1:] / np.maximum(n, 1)[:, :, None]
    squares = added(rows, lambda c: parts(c, lambda used, at: ((c["x"][used] - mean[at]) ** 2).sum(axis=0), mean.shape)).reshape(mean.shape)
    # A constant feature is centred and left unscaled.
    return mean, np.where(squares > 0, np.sqrt(squares / np.maximum(n, 1)[:, :, None]), 1.0), n


def held_out_cells(rows: DataFrame, kernel_groups: list[dict], w: np.ndarray, classes: int) -> DataFrame:
    """(model, y_true, y_pred, w): what each model of a fold says of the rows that the fold left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), classes, classes), np.int64)
        for batch in batches:
            c = columns_of(batch)
            for group in kernel_groups:
                out = c["fold"] == group["fold"]
                if not out.any():
                    continue
                x = (c["x"][out] - group["center"]) / group["spread"]
                x, y = np.concatenate([x, np.ones((len(x), 1))], axis=1), c["y"][out].astype(int)
                own = w[group["models"]]
                said = np.einsum("nd,mdc->mnc", x, own.reshape(len(own), -1, classes), optimize=True).argmax(axis=2)
                for k, answer in zip(range(len(w))[group["models"]], said, strict=True):
                    np.add.at(total[k], (y, answer), 1)
        model, true, pred = np.nonzero(total)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        found = [pa.array(v, t) for v, t in zip((model, true, pred, total[model, true, pred]), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(found, ["model", "y_true", "y_pred", "w"])

    found = rows.mapInArrow(run, "model int, y_true int, y_pred int, w bigint")
    return found.groupBy("model", "y_true", "y_pred").agg(F.sum("w").alias("w"))
