"""Which (model, task) runs are still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["task_name", "model_org", "model_ckpt", "n_train"]


def wanted_runs(grid: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every configuration with every task; the few tasks are exploded in place.

    ``tasks`` has ``task_name``, ``data_root`` (null or empty without data) and
    ``has_code``.
    """
    listed = F.collect_list(F.struct(F.lower("task_name").alias("task_name"), "data_root", "has_code"))
    known = tasks.agg(F.sort_array(listed).alias("t")).scalar()
    return grid.select("*", F.explode(known).alias("_t")).select(*grid.columns, "_t.*")


def backlog(wanted: DataFrame, done: DataFrame, claims: DataFrame) -> DataFrame:
    """Reason per wanted run: no code, no data, done, queued, or todo."""
    finished = done.select(F.lower("task_name").alias("task_name"), *KEY[1:]).distinct()
    claimed = claims.select(F.lower("task_name").alias("task_name"), *KEY[1:]).distinct()
    out = wanted.join(finished.withColumn("_done", F.lit(True)), KEY, "left")
    out = out.join(claimed.withColumn("_claimed", F.lit(True)), KEY, "left")
    reason = (
        F.when(~F.col("has_code"), "no code")
        .when(F.coalesce(F.col("data_root"), F.lit("")) == "", "no data")
        .when(F.col("_done"), "done")
        .when(F.col("_claimed"), "queued")
        .otherwise("todo")
    )
    return out.withColumn("reason", reason).drop("_done", "_claimed")


def todo(wanted: DataFrame, done: DataFrame, claims: DataFrame) -> DataFrame:
    """Only the runs that should start."""
    return backlog(wanted, done, claims).where(F.col("reason") == "todo")


def summarize_backlog(runs: DataFrame) -> DataFrame:
    """Number of runs per reason, with a null reason for the total."""
    return runs.rollup("reason").agg(F.count(F.lit(1)).alias("n"))


def todo_by_model(runs: DataFrame) -> DataFrame:
    """Number of runs to do per checkpoint."""
    return runs.where(F.col("reason") == "todo").groupBy("model_ckpt").agg(F.count(F.lit(1)).alias("n"))
