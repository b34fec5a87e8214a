"""Score report: point scores, bootstrap intervals and the models tied for best."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.labels import UNKNOWN, cast_label, parse_info
from evalspark.functions.text import json_labels
from evalspark.operators import bootstrap as boot
from evalspark.operators import costs, metrics
from evalspark.operators.tables import filter_known, union_all
from evalspark.scaling import materialize

logger = logging.getLogger(__name__)

# Tasks of the leaderboard with their display names and score.
PRIOR_WORK_TASKS = {"imagenet1k": "ImageNet-1K", "newt": "NeWT", "inat21": "iNat21"}
BENCHMARK_TASKS = {
    "beluga": "Beluga",
    "ecdysis": "Ecdysis",
    "fishnet": "FishNet",
    "fungiclef": "FungiCLEF",
    "herbarium19": "Herbarium19",
    "iwildcam": "iWildCam",
    "kabr": "KABR",
    "mammalnet": "MammalNet",
    "plankton": "Plankton",
    "plantnet": "Pl@ntNet",
}
TASK_SCORES = {
    "imagenet1k": "accuracy",
    "newt": "mean",
    "inat21": "accuracy",
    "beluga": "macro_f1",
    "ecdysis": "macro_f1",
    "fishnet": "multilabel",
    "fungiclef": "user_loss",
    "herbarium19": "macro_f1",
    "iwildcam": "macro_f1",
    "kabr": "macro_f1",
    "mammalnet": "macro_f1",
    "plankton": "macro_f1",
    "plantnet": "macro_f1",
}

BY = [boot.TASK, boot.MODEL]


def analysis_frame(results: DataFrame, tasks: Iterable[str] | None = None, models: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Full-data predictions of known tasks and models with labels read from the JSON text."""
    known = filter_known(results, tasks, models)
    return parse_info(known, ood=True).select("task_name", "model_ckpt", "img_id", "score", "y_true", "y_pred", "ood")


def int_labels(df: DataFrame) -> DataFrame:
    """Text labels as integers."""
    return df.withColumns({name: cast_label(F.col(name)) for name in ("y_true", "y_pred")})


def known_labels(df: DataFrame) -> DataFrame:
    """Integer labels, with the unknown class as truth of the rows marked ``ood``."""
    df = int_labels(df)
    if "ood" not in df.columns:
        return df
    return df.withColumn("y_true", F.when(F.col("ood"), UNKNOWN).otherwise(F.col("y_true")))


def array_labels(df: DataFrame) -> DataFrame:
    """Text labels as integer arrays."""
    return df.withColumns({name: json_labels(F.col(name)) for name in ("y_true", "y_pred")})


def _families(harmful, inner: int = 1, map_ood: bool = True) -> dict[str, tuple[Callable, Callable, Callable]]:
    """Per kind of score: label conversion, point score, replicates."""

    def user_loss(df, by):
        return costs.user_loss_norm(df, by, harmful)

    def user_loss_replicates(df, b, seed, method):
        return boot.bootstrap_user_loss(df, harmful, b, seed, method)

    def macro_f1_replicates(df, b, seed, method):
        return boot.bootstrap_macro_f1(df, b, seed, method, inner)

    return {
        "mean": (lambda df: df, metrics.mean_score, boot.bootstrap_mean),
        "accuracy": (int_labels, metrics.micro_acc, boot.bootstrap_accuracy),
        "macro_f1": (int_labels, metrics.macro_f1, macro_f1_replicates),
        "multilabel": (array_labels, metrics.multilabel_macro_f1, boot.bootstrap_multilabel),
        "user_loss": (known_labels if map_ood else int_labels, user_loss, user_loss_replicates),
    }


def calc_scores(
    predictions: DataFrame,
    b: int = 500,
    alpha: float = 0.05,
    seed: int = 17,
    method: str = "multinomial",
    task_scores: dict[str, str] | None = None,
    harmful: Iterable[int] | DataFrame = (),
    inner: int = 1,
    equal_n: bool = True,
    map_ood: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Scores ``(task, model, mean, bootstrap_mean, ci_low, ci_high)`` and bests ``(task, best, ties)``.

    All tasks with the same kind of score are computed together, so the number of
    Spark jobs does not grow with the number of tasks. A macro-F1 replicate is the mean of ``inner`` draws. Models
    of a task with different numbers of rows are an error unless ``equal_n`` is false. The user loss takes rows marked
    ``ood`` as the unknown class unless ``map_ood`` is false.
    """
    task_scores = TASK_SCORES if task_scores is None else task_scores
    present = {row[0] for row in predictions.select(boot.TASK).distinct().collect()}
    for name in sorted(present - set(task_scores)):
        logger.warning("No score for task '%s'.", name)
    points, replicates = [], []
    for kind, (convert, point, resample) in _families(harmful, inner, map_ood).items():
        names = sorted(t for t in present if task_scores.get(t) == kind)
        if not names:
            continue
        rows = boot.dedup_predictions(convert(predictions.where(F.col(boot.TASK).isin(names))))
        # Parsed once; read by the point score, the positions and the replicates.
        rows = materialize(rows, f"rows-{kind}")
        if equal_n:
            metrics.assert_equal_n(rows, BY, within=boot.TASK)
        points.append(point(rows, BY))
        replicates.append(resample(rows, b, seed, method))
    if not points:
        raise ValueError("no predictions of a known task")
    # b values per task and model, read by the interval, the best model and the tests.
    values = materialize(union_all(replicates), "replicates")
    scores = union_all(points).withColumnRenamed("value", "mean").join(boot.summarize_ci(values, alpha), BY)
    scores = scores.withColumnsRenamed({boot.TASK: "task", boot.MODEL: "model"})
    bests = boot.best_and_ties(values, alpha).withColumnRenamed(boot.TASK, "task")
    return scores, bests
