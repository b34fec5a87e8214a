"""Cost metrics with an unknown class (-1) and a set of harmful classes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.labels import UNKNOWN
from evalspark.operators.metrics import cells, macro_f1


@dataclass(frozen=True)
class Costs:
    """Price of each kind of error."""

    unknown_as_known: float = 10.0
    known_as_unknown: float = 0.1
    harmful_missed: float = 100.0
    harmless_flagged: float = 1.0


def flag_harmful(df: DataFrame, harmful: Iterable[int] | DataFrame) -> DataFrame:
    """Add ``true_harmful`` and ``pred_harmful``.

    A short list becomes a membership test. A table of classes is joined, and Spark
    picks the join by the table's size.
    """
    if not isinstance(harmful, DataFrame):
        labels = list(harmful)
        return df.withColumns(
            {"true_harmful": F.col("y_true").isin(labels), "pred_harmful": F.col("y_pred").isin(labels)}
        )
    classes = harmful.select(F.col(harmful.columns[0]).alias("_c")).distinct()
    for side in ("true", "pred"):
        marked = classes.select(F.col("_c").alias(f"_{side}"), F.lit(True).alias(f"{side}_harmful"))
        df = df.join(marked, F.col(f"y_{side}") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return df.fillna(False, ["true_harmful", "pred_harmful"])


def _sum(flag: Column, weight: str | None) -> Column:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return F.sum(F.when(flag, w).otherwise(0.0))


def _unknown_cost(weight: str | None, as_known: float, as_unknown: float) -> Column:
    true_unknown, pred_unknown = F.col("y_true") == UNKNOWN, F.col("y_pred") == UNKNOWN
    other = (F.col("y_true") != F.col("y_pred")) & ~true_unknown & ~pred_unknown
    return (
        _sum(other, weight)
        + as_known * _sum(true_unknown & ~pred_unknown, weight)
        + as_unknown * _sum(~true_unknown & pred_unknown, weight)
    ) / _sum(F.lit(True), weight)


def _harm_cost(weight: str | None, costs: Costs) -> Column:
    missed = _sum(F.col("true_harmful") & ~F.col("pred_harmful"), weight)
    flagged = _sum(~F.col("true_harmful") & F.col("pred_harmful"), weight)
    return (costs.harmful_missed * missed + costs.harmless_flagged * flagged) / _sum(F.lit(True), weight)


def unknown_error(df: DataFrame, by: list[str], weight: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """Classification error with separate prices for errors on the unknown class."""
    cost = _unknown_cost(weight, costs.unknown_as_known, costs.known_as_unknown)
    return df.groupBy(*by).agg(cost.alias("value"))


def class_error(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Plain classification error: every kind of error costs one."""
    return df.groupBy(*by).agg(_unknown_cost(weight, 1.0, 1.0).alias("value"))


def psc_esc(df: DataFrame, by: list[str], harmful: Iterable[int] | DataFrame) -> DataFrame:
    """Counts of harmful rows missed (``psc``) and harmless rows flagged (``esc``)."""
    true, pred = F.col("true_harmful"), F.col("pred_harmful")
    return flag_harmful(df, harmful).groupBy(*by).agg(
        F.count_if(true & ~pred).alias("psc"), F.count_if(~true & pred).alias("esc")
    )


def psc_esc_cost(
    df: DataFrame, by: list[str], harmful: Iterable[int] | DataFrame, weight: str | None = None, costs: Costs = Costs()
) -> DataFrame:
    """Weighted harm cost per row."""
    return flag_harmful(df, harmful).groupBy(*by).agg(_harm_cost(weight, costs).alias("value"))


def user_loss(
    df: DataFrame, by: list[str], harmful: Iterable[int] | DataFrame, weight: str | None = None, costs: Costs = Costs()
) -> DataFrame:
    """Error with unknowns plus the harm cost."""
    cost = _unknown_cost(weight, costs.unknown_as_known, costs.known_as_unknown)
    return flag_harmful(df, harmful).groupBy(*by).agg((cost + _harm_cost(weight, costs)).alias("value"))


def user_loss_norm(
    df: DataFrame,
    by: list[str],
    harmful: Iterable[int] | DataFrame,
    weight: str | None = None,
    costs: Costs = Costs(),
    shared: list[str] | None = None,
) -> DataFrame:
    """1 minus the user loss divided by the largest loss possible for the same truth.

    ``shared`` names a coarser grouping whose pooled truth sets the largest loss, so
    that all replicates of a bootstrap are put on one scale.
    """
    parts = flag_harmful(df, harmful).groupBy(*by).agg(
        (
            _unknown_cost(weight, costs.unknown_as_known, costs.known_as_unknown) + _harm_cost(weight, costs)
        ).alias("_loss"),
        _sum(F.lit(True), weight).alias("_n"),
        _sum(F.col("y_true") == UNKNOWN, weight).alias("_unknown"),
        _sum(F.col("true_harmful"), weight).alias("_harmful"),
    )
    sums = [F.col("_n"), F.col("_unknown"), F.col("_harmful")]
    if shared is not None:
        pooled = parts.groupBy(*shared).agg(
            F.sum("_n").alias("_pn"), F.sum("_unknown").alias("_pu"), F.sum("_harmful").alias("_ph")
        )
        parts = parts.join(pooled, shared) if shared else parts.withColumns(
            {name: pooled.select(name).scalar() for name in ("_pn", "_pu", "_ph")}
        )
        sums = [F.col("_pn"), F.col("_pu"), F.col("_ph")]
    n, unknown, harmful_n = sums
    worst_error = (costs.unknown_as_known - 1) * unknown / n + 1
    worst_harm = (costs.harmful_missed * harmful_n + costs.harmless_flagged * (n - harmful_n)) / n
    return parts.select(*by, (1 - F.col("_loss") / (worst_error + worst_harm)).alias("value"))


def cost_report(df: DataFrame, by: list[str], harmful: Iterable[int] | DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Macro F1 (percent), plain error, harm cost, user loss and error with unknowns.

    Both halves start from the same (truth, prediction) cells, which Spark computes once.
    """
    counted = cells(df, by)
    sums = flag_harmful(counted, harmful).groupBy(*by).agg(
        _unknown_cost("w", 1.0, 1.0).alias("ce"),
        _harm_cost("w", costs).alias("psc_esc_cost"),
        _unknown_cost("w", costs.unknown_as_known, costs.known_as_unknown).alias("ce_unk"),
    )
    f1 = macro_f1(df, by, present_only=True).withColumn("f1_macro", F.col("value") * 100).drop("value")
    return f1.join(sums, by).withColumn("user_loss", F.col("ce_unk") + F.col("psc_esc_cost"))


# Flags of a row in ``error_codes``, lowest bit first.
ERROR_BITS = ["wrong_class", "unknown_as_known", "known_as_unknown", "harmful_missed", "harmless_flagged", "unknown", "harmful"]


def error_codes(df: DataFrame, harmful: Iterable[int] | DataFrame, name: str) -> DataFrame:
    """Add an integer with one bit per kind of error and truth of a row, so that rows can be counted by it."""
    true, pred = F.col("y_true") == UNKNOWN, F.col("y_pred") == UNKNOWN
    flags = [
        (F.col("y_true") != F.col("y_pred")) & ~true & ~pred,
        true & ~pred,
        ~true & pred,
        F.col("true_harmful") & ~F.col("pred_harmful"),
        ~F.col("true_harmful") & F.col("pred_harmful"),
        true,
        F.col("true_harmful"),
    ]
    code = F.lit(0)
    for k, flag in enumerate(flags):
        code = code + F.when(flag, 1 << k).otherwise(0)
    return flag_harmful(df, harmful).withColumn(name, code.cast("int"))


def pooled_user_loss(total: np.ndarray, costs: Costs = Costs()) -> np.ndarray:
    """Normalised user loss of every replicate from the row counts of ``ERROR_BITS`` and all rows, one column each.

    The largest possible loss is that of the truth of all replicates together. A replicate without rows is nan.
    """
    wrong, as_known, as_unknown, missed, flagged, unknown, harmful, n = total
    loss = wrong + costs.unknown_as_known * as_known + costs.known_as_unknown * as_unknown
    loss = loss + costs.harmful_missed * missed + costs.harmless_flagged * flagged
    every, unknown, harmful = n.sum(), unknown.sum(), harmful.sum()
    worst = (costs.unknown_as_known - 1) * unknown / every + 1
    worst += (costs.harmful_missed * harmful + costs.harmless_flagged * (every - harmful)) / every
    return 1 - np.divide(loss, n, out=np.full(len(n), np.nan), where=n > 0) / worst
