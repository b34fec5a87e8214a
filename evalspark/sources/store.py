"""Results store: one experiments row and many predictions per run, as Parquet.

A run's predictions are written first, under its task's partition; its experiments
row follows. Readers join the two, so a run that failed half-way is never seen.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.tables import join_results
from evalspark.scaling import setting

EXPERIMENTS_SCHEMA = (
    "id bigint, task_name string, model_org string, model_ckpt string, n_train int, exp_cfg string, "
    "argv string, splits map<string,double>, git_commit string, posix double, gpu_name string, hostname string"
)
PREDICTIONS_SCHEMA = "img_id string, score double, info string, experiment_id bigint, task_name string"


@dataclass(frozen=True)
class RunInfo:
    """Provenance of one run, supplied by the caller."""

    task_name: str
    model_org: str
    model_ckpt: str
    n_train: int = -1
    exp_cfg: dict = field(default_factory=dict)
    argv: list = field(default_factory=list)
    splits: dict = field(default_factory=dict)
    git_commit: str = ""
    posix: float = 0.0
    gpu_name: str | None = None
    hostname: str = ""


RUN_KEY = ["task_name", "model_org", "model_ckpt", "n_train", "posix"]


# Files that a task's predictions of one call are cut into at most.
TASK_FILES = 256


def attempt_ids(count: int, after: int = 0) -> list[int]:
    """Distinct ids of the runs of one call, above `after`: milliseconds and 22 random bits, so that two calls at once
    have the same only by a chance of one in four million for a pair of runs in the same millisecond."""
    start = max(time.time_ns() // 1_000_000, (after >> 22) + 1) << 22
    drawn: set[int] = set()
    while len(drawn) < count:
        drawn.add(start + len(drawn) // 1024 * (1 << 22) + uuid.uuid4().int % (1 << 22))
    return sorted(drawn)


def last_attempt(spark: SparkSession, folder: str) -> int:
    """Largest id in the store, 0 if it is empty; a later attempt goes above it, whatever the writers' clocks say."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/experiments")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return 0
    rows = spark.read.schema(EXPERIMENTS_SCHEMA).parquet(f"{folder}/experiments")
    return rows.agg(F.max("id")).first()[0] or 0


def prediction_info(y_true: Column, y_pred: Column, **extra: Column) -> Column:
    """JSON text stored with a prediction."""
    fields = [y_true.alias("y_true"), y_pred.alias("y_pred"), *[c.alias(name) for name, c in extra.items()]]
    return F.to_json(F.struct(*fields))


def write_report(predictions: DataFrame, info: RunInfo, folder: str) -> None:
    """Append the predictions ``(img_id, score, info)`` of one run, then its experiments row.

    Both carry the id of this attempt, so predictions of an attempt that failed before its experiments row are never
    joined. A later attempt with the same key and time supersedes an earlier one.
    """
    named = predictions.select("img_id", "score", "info", F.lit(info.task_name).alias("task_name"), F.lit(info.model_ckpt).alias("model_ckpt"))
    write_reports(named, [info], folder)


def write_reports(predictions: DataFrame, infos: list[RunInfo], folder: str) -> None:
    """Append several runs in one pass: all predictions ``(task_name, model_ckpt, img_id, score, info)``, then all
    experiments rows.

    A task and model may stand for one run of the call only. A prediction of a run that ``infos`` does not name is an
    error, and so is a second prediction for an example of a run. Rows are dealt by task and example before they are
    written, which checks that and keeps the number of files low.
    """
    spark = predictions.sparkSession
    ids = attempt_ids(len(infos), last_attempt(spark, folder))
    runs = {(info.task_name.lower(), info.model_ckpt): (i, info) for i, info in zip(ids, infos, strict=True)}
    if len(runs) < len(infos):
        raise ValueError("two runs of the same task and model in one call")
    ids = spark.createDataFrame([(*key, attempt) for key, (attempt, _) in runs.items()], "_task string, _model string, _attempt bigint")
    lower = predictions.withColumn("task_name", F.lower("task_name"))
    placed = lower.join(ids, (F.col("task_name") == F.col("_task")) & (F.col("model_ckpt") == F.col("_model")), "left")
    stray = F.raise_error(F.concat_ws(" ", F.lit("no run for"), "task_name", "model_ckpt")).cast("bigint")
    rows = placed.select("img_id", "score", "info", F.coalesce("_attempt", stray).alias("experiment_id"), "task_name")
    dealt = rows.withColumn("_file", F.pmod(F.hash("img_id"), F.lit(setting(spark, "taskFiles", TASK_FILES))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key = ["task_name", "_file", "experiment_id", "img_id"]
    once = dealt.repartition(parts, "task_name", "_file").groupBy(*key).agg(
        F.first("score").alias("score"), F.first("info").alias("info"), F.count(F.lit(1)).alias("_n")
    )
    twice = F.raise_error(F.concat_ws(" ", F.lit("two predictions for"), "task_name", "img_id")).cast("string")
    rows = once.select(F.when(F.col("_n") == 1, F.col("img_id")).otherwise(twice).alias("img_id"), "score", "info", "experiment_id", "task_name")
    rows.write.mode("append").partitionBy("task_name").parquet(f"{folder}/predictions")
    values = [
        (
            attempt, task, info.model_org, info.model_ckpt, info.n_train, json.dumps(info.exp_cfg), json.dumps(info.argv),
            {k: float(v) for k, v in info.splits.items()}, info.git_commit, float(info.posix), info.gpu_name, info.hostname,
        )
        for (task, _), (attempt, info) in runs.items()
    ]
    spark.createDataFrame(values, EXPERIMENTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/experiments")


def read_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """The last attempt of every run."""
    rows = spark.read.schema(EXPERIMENTS_SCHEMA).parquet(f"{folder}/experiments")
    last = rows.groupBy(*RUN_KEY).agg(F.max_by(F.struct(*rows.columns), "id").alias("_run"))
    return last.select("_run.*")


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS_SCHEMA).parquet(f"{folder}/predictions")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of all complete runs with task, model and training size."""
    return join_results(read_experiments(spark, folder), read_predictions(spark, folder))


def results_document(
    scores: DataFrame, bests: DataFrame, models: DataFrame, benchmark_tasks: DataFrame, prior_work_tasks: DataFrame, meta: dict
) -> DataFrame:
    """One-row JSON document of the leaderboard, whose size follows models x tasks only."""

    def rows(df: DataFrame, key: list[str]) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(F.struct(*key).alias("k"), F.struct(*df.columns).alias("v"))))
        return df.agg(F.transform(ordered, lambda r: r["v"]).alias("v")).scalar()

    spark = scores.sparkSession
    head = spark.range(1).select(
        F.struct(*[F.lit(value).alias(name) for name, value in meta.items()]).alias("meta"),
        rows(models, ["ckpt"]).alias("models"),
        rows(benchmark_tasks, ["name"]).alias("benchmark_tasks"),
        rows(prior_work_tasks, ["name"]).alias("prior_work_tasks"),
        rows(scores, ["task", "model"]).alias("results"),
        rows(bests, ["task"]).alias("bests"),
    )
    return head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_results_json(document: DataFrame, path: str) -> None:
    """Write the document as one text file."""
    document.coalesce(1).write.mode("overwrite").text(path)
