"""Leaderboard tables over scores ``(task, model, mean)``; their size is models x tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import log10_params, percent_label
from evalspark.operators.rankstats import linear_fit


def pivot_scores(scores: DataFrame, tasks: list[str]) -> DataFrame:
    """One row per model, one column per task."""
    return scores.groupBy("model").pivot("task", tasks).agg(F.first("mean"))


def _complete(tasks: Iterable[str]) -> Column:
    wanted = sorted(set(tasks))
    chosen = F.col("task").isin(wanted)
    mean = F.avg(F.when(chosen, F.col("mean")))
    n = F.count(F.when(chosen & F.col("mean").isNotNull(), 1))
    return F.when(n == len(wanted), mean)


def complete_mean(scores: DataFrame, tasks: Iterable[str]) -> DataFrame:
    """Mean over the tasks per model; null unless the model has all of them."""
    return scores.groupBy("model").agg(_complete(tasks).alias("mean"))


def leaderboard(scores: DataFrame, tasks: list[str], selected: Iterable[str] | None = None) -> DataFrame:
    """Wide table with the mean over the selected tasks in column ``mean``, from one grouping."""
    selected = [t for t in tasks if selected is None or t in set(selected)]
    columns = [F.first(F.when(F.col("task") == t, F.col("mean")), ignorenulls=True).alias(t) for t in tasks]
    return scores.groupBy("model").agg(*columns, _complete(selected).alias("mean"))


def winners(bests: DataFrame) -> DataFrame:
    """Model and task pairs that carry a winner mark."""
    return bests.select(F.explode("ties").alias("model"), "task")


def with_winners(wide: DataFrame, bests: DataFrame) -> DataFrame:
    """Add the sorted list of tasks each model wins or ties."""
    won = winners(bests).groupBy("model").agg(F.sort_array(F.collect_set("task")).alias("winners"))
    out = wide.join(won, "model", "left")
    return out.withColumn("winners", F.coalesce("winners", F.array().cast("array<string>")))


def filter_models(
    df: DataFrame, families: list[str], resolutions: list[int], ranges: list[tuple[int, int]]
) -> DataFrame:
    """Models of the families and resolutions whose parameter count lies inside a range.

    Ranges are open at both ends.
    """
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | ((F.col("params") > low) & (F.col("params") < high))
    return df.where(F.col("family").isin(families) & F.col("resolution").isin(resolutions) & inside)


def sort_keys(key: str, tie: str, numeric: bool = True, descending: bool = True) -> list[Column]:
    """Sort order of a column: a missing number is the smallest, a missing text the largest value.

    Descending is the exact reverse of ascending, tie-break included.
    """
    if numeric:
        return [F.desc_nulls_last(key), F.desc(tie)] if descending else [F.asc_nulls_first(key), F.asc(tie)]
    return [F.desc_nulls_first(key), F.desc(tie)] if descending else [F.asc_nulls_last(key), F.asc(tie)]


def sort_leaderboard(df: DataFrame, key: str, tie: str = "model", numeric: bool = True, descending: bool = True) -> DataFrame:
    """Rows in leaderboard order."""
    return df.orderBy(*sort_keys(key, tie, numeric, descending))


def select_tasks(df: DataFrame, cols: list[str], always: list[str]) -> DataFrame:
    """The always shown columns and the visible ones."""
    return df.select(*always, *[c for c in cols if c in df.columns and c not in always])


def score_trend(wide: DataFrame, x_task: str, y_tasks: list[str]) -> DataFrame:
    """Line and R2 of each task score on the reference task, both in percent."""
    long = wide.unpivot(["model", x_task], y_tasks, "task", "score") if x_task not in y_tasks else (
        wide.withColumn("_x", F.col(x_task)).unpivot(["model", "_x"], y_tasks, "task", "score")
    )
    x = x_task if x_task not in y_tasks else "_x"
    return linear_fit(long, ["task"], F.col(x) * 100, F.col("score") * 100)


def params_trend(scores: DataFrame, models: DataFrame) -> DataFrame:
    """Line and R2 of each task score (percent) on log10 of the parameter count."""
    joined = scores.join(models.select(F.col("model_ckpt").alias("model"), "params"), "model")
    return linear_fit(joined, ["task"], log10_params(F.col("params")), F.col("mean") * 100)


def line_points(fits: DataFrame) -> DataFrame:
    """End points of each fitted line over its x range."""
    at = F.explode(F.array("x_min", "x_max")).alias("x")
    return fits.select("task", "slope", "intercept", at).select(
        "task", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y")
    )


def complete_matrix(scores: DataFrame, tasks: list[str], models: DataFrame, drop_families: list[str]) -> DataFrame:
    """Models with a score on every task, without the excluded families."""
    kept = models.where(~F.col("family").isin(drop_families)).select(F.col("model_ckpt").alias("model"))
    wide = pivot_scores(scores, tasks).dropna(subset=tasks)
    mean = sum((F.col(t) for t in tasks[1:]), F.col(tasks[0])) / len(tasks)
    return wide.join(kept, "model", "left_semi").withColumn("mean", mean)


def bar_series(scores: DataFrame, models: DataFrame) -> DataFrame:
    """Model, family and score per task; missing scores are dropped."""
    dims = models.select(F.col("model_ckpt").alias("model"), "family")
    return scores.where(F.col("mean").isNotNull()).join(dims, "model").select("task", "model", "family", F.col("mean").alias("score"))


def text_table(scores: DataFrame, tasks: list[str], benchmark: list[str], min_tasks: int = 9) -> DataFrame:
    """One text line per model: scores in percent, then the mean if enough tasks are there."""
    wide = pivot_scores(scores, tasks)
    in_benchmark = F.col("task").isin(benchmark)
    means = scores.where(in_benchmark & F.col("mean").isNotNull()).groupBy("model").agg(
        F.avg("mean").alias("_mean"), F.count(F.lit(1)).alias("_n")
    )
    joined = wide.join(means, "model", "left")
    cell = [F.when(F.col(t).isNotNull(), percent_label(F.col(t))).otherwise("") for t in tasks]
    last = F.when(F.col("_n") >= min_tasks, percent_label(F.col("_mean"))).otherwise("")
    line = F.concat(F.col("model"), F.lit(" "), F.concat_ws(" & ", *cell, last))
    return joined.select("model", line.alias("line"))
