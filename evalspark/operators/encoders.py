"""Registries of encoders and metrics supplied by the user."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

# Loads a checkpoint once per task and returns a function from a batch of inputs to
# vectors (n x d), or to a pair of vectors and patches (n x p x d).
Loader = Callable[[str], Callable[[pd.Series], np.ndarray]]


@dataclass(frozen=True)
class Encoder:
    load: Loader
    patches: bool = False
    normalize: Callable[[Column], Column] = lambda ckpt: ckpt


_encoders: dict[str, Encoder] = {}
_metrics: dict[str, Callable[..., DataFrame]] = {}


def register_encoder(
    org: str, load: Loader, patches: bool = False, normalize: Callable[[Column], Column] | None = None
) -> None:
    """Register an encoder family; a second registration replaces the first with a warning."""
    if org in _encoders:
        logger.warning("Overwriting encoder '%s'.", org)
    _encoders[org] = Encoder(load, patches, normalize or (lambda ckpt: ckpt))


def list_encoders() -> list[str]:
    """Registered encoder families."""
    return list(_encoders)


def get_encoder(org: str) -> Encoder:
    if org not in _encoders:
        raise ValueError(f"no encoder family is registered as {org!r}")
    return _encoders[org]


def embed(df: DataFrame, org: str, ckpt: str, col: str, out: str = "embedding") -> DataFrame:
    """Add the vector of each input, and ``patches`` when the encoder gives them.

    The checkpoint is loaded once per task, then Arrow batches stream through it.
    """
    encoder = get_encoder(org)
    load, patches = encoder.load, encoder.patches
    kind = f"struct<vec:array<double>{',patches:array<array<double>>' if patches else ''}>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = load(ckpt)
        for batch in batches:
            result = encode(batch)
            vectors, extra = result if patches else (result, None)
            frame = {"vec": list(np.asarray(vectors, dtype=np.float64))}
            if patches:
                frame["patches"] = [[row for row in item] for item in np.asarray(extra, dtype=np.float64)]
            yield pd.DataFrame(frame)

    added = df.withColumn("_e", run(F.col(col)))
    names = {out: F.col("_e.vec")}
    if patches:
        names["patches"] = F.col("_e.patches")
    return added.withColumns(names).drop("_e")


def normalize_ckpt(df: DataFrame, org: str = "model_org", ckpt: str = "model_ckpt") -> DataFrame:
    """Replace checkpoints by the canonical name their encoder family defines; unknown families fail."""
    value = None
    for name, encoder in _encoders.items():
        match = F.col(org) == name
        value = F.when(match, encoder.normalize(F.col(ckpt))) if value is None else value.when(match, encoder.normalize(F.col(ckpt)))
    missing = F.raise_error(F.concat(F.lit("Org not found: "), F.coalesce(F.col(org), F.lit("null")))).cast("string")
    return df.withColumn(ckpt, missing if value is None else value.otherwise(missing))


def register_metric(task: str, metric: Callable[..., DataFrame]) -> None:
    """Register the metric of a task: ``metric(df, by, weight=None)`` gives ``by`` and ``value``."""
    if task in _metrics:
        logger.warning("Overwriting metric of task '%s'.", task)
    _metrics[task] = metric


def batch_metric(partial: Callable[[pd.DataFrame], dict[str, float]], finish: Callable[..., Column], names: list[str]):
    """Metric from a function on pandas batches.

    ``partial`` turns any batch of one group's rows into named sums, so a group of any
    size is reduced where it lies; ``finish`` combines the summed columns.
    """

    def metric(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
        if weight is not None:
            raise ValueError("batch metrics take no weights")
        schema = df.select(*by).schema
        for name in names:
            schema = schema.add(name, "double")

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, part in batch.groupby(by, dropna=False, sort=False):
                    sums = partial(part)
                    rows.append([*key, *[float(sums[name]) for name in names]])
                yield pd.DataFrame(rows, columns=[*by, *names])

        summed = df.mapInPandas(reduce, schema).groupBy(*by).agg(*[F.sum(name).alias(name) for name in names])
        return summed.select(*by, finish(*[F.col(name) for name in names]).alias("value"))

    return metric


def apply_scorer(df: DataFrame, task: str = "task_name", model: str = "model_ckpt") -> DataFrame:
    """Score every registered task with its own metric; other tasks are left out with a warning."""
    present = {row[0] for row in df.select(task).distinct().collect()}
    for name in sorted(present - set(_metrics)):
        logger.warning("No metric for task '%s'.", name)
    parts = [_metrics[name](df.where(F.col(task) == name), [task, model]) for name in sorted(present & set(_metrics))]
    if not parts:
        return df.select(task, model, F.lit(0.0).alias("value")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
