"""End to end: stored vectors, a classifier, prediction rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.labels import correctness
from evalspark.operators.centroid import simpleshot_fit
from evalspark.operators.tables import flag_ood
from evalspark.sources.store import RunInfo, prediction_info, write_report

# Takes the training rows and returns a function that adds ``y_pred`` to other rows.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def simpleshot(col: str = "embedding", label: str = "label", id_col: str = "id") -> Fit:
    """Nearest-centroid classifier in the form ``run_probe`` takes."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = simpleshot_fit(train, col, label)
        return lambda df: model.predict(df, id_col)

    return fit


def run_probe(train: DataFrame, test: DataFrame, fit: Fit, label: str = "label", id_col: str = "id") -> DataFrame:
    """Fit on the training rows and return report rows ``(img_id, score, info, y_true, y_pred, ood)``."""
    predicted = flag_ood(fit(train)(test), train, label)
    rows = predicted.select(F.col(id_col).cast("string").alias("img_id"), F.col(label).alias("y_true"), "y_pred", "ood")
    return rows.withColumn("score", correctness()).withColumn(
        "info", prediction_info(F.col("y_true"), F.col("y_pred"), ood=F.col("ood"))
    )


def run_and_store(train: DataFrame, test: DataFrame, fit: Fit, info: RunInfo, folder: str, label: str = "label", id_col: str = "id") -> None:
    """Run the probe and append its report to the results store."""
    write_report(run_probe(train, test, fit, label, id_col), info, folder)
