"""Evaluation tables derived from the given tables, as DataFrames and as SQL.

Orders stand for test examples and eight models predict a label in 0..19 for each;
order status is the task. Suppliers stand for a large set of models whose scores on
three tasks come from line items. Embeddings are labelled vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MODELS = 8
CLASSES = 20
# One predictor in these SQL texts is written as m0..m7.
PREDS = """
preds AS (
  SELECT task_name, model_ckpt, img_id, k, y_true,
         CAST(CASE WHEN h < 40 + 5 * k THEN y_true ELSE (y_true + 1 + h % 19) % 20 END AS INTEGER) AS y_pred
  FROM (
    SELECT o_orderstatus AS task_name, 'm' || k AS model_ckpt, CAST(o_orderkey AS VARCHAR) AS img_id, k,
           CAST(o_custkey % 20 AS INTEGER) AS y_true, (o_orderkey * 31 + k * 17) % 100 AS h
    FROM orders, (SELECT unnest(range(8)) AS k)
  )
)"""

# Label 0 is the unknown class; classes 1 and 3 are harmful.
UNKNOWN_PREDS = (
    PREDS
    + """,
upreds AS (
  SELECT task_name, model_ckpt, img_id,
         CASE WHEN y_true = 0 THEN -1 ELSE y_true END AS y_true,
         CASE WHEN y_pred = 0 THEN -1 ELSE y_pred END AS y_pred
  FROM preds
)"""
)
HARMFUL = [1, 3]

EXPERIMENTS = (
    PREDS
    + """,
experiments AS (
  SELECT DISTINCT k * 100 + ascii(task_name) AS id, task_name, model_ckpt,
         CASE WHEN k = 7 THEN 100 ELSE -1 END AS n_train
  FROM preds
)"""
)

SCORES = """
scores AS (
  SELECT l_returnflag AS task, 's' || l_suppkey AS model, round(avg(l_discount), 9) AS mean
  FROM lineitem GROUP BY 1, 2
)"""
TASKS = ["A", "N", "R"]

WIDE = (
    SCORES
    + """,
wide AS (
  SELECT model, max(CASE WHEN task = 'A' THEN mean END) AS "A", max(CASE WHEN task = 'N' THEN mean END) AS "N",
         max(CASE WHEN task = 'R' THEN mean END) AS "R"
  FROM scores GROUP BY model
),
complete AS (
  SELECT model, "A", "N", "R", ("A" + "N" + "R") / 3 AS mean FROM wide
  WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL
)"""
)

# Supplier nation gives the family and the account balance the size of a model.
DIMS = """
dims AS (
  SELECT 's' || s_suppkey AS model_ckpt, 'f' || s_nationkey % 3 AS family,
         CAST(CASE s_nationkey % 3 WHEN 0 THEN 224 WHEN 1 THEN 256 ELSE 384 END AS INTEGER) AS resolution,
         CASE WHEN s_suppkey = 5 THEN 50000000
              ELSE CAST(floor((s_acctbal + 1000) * 200000) AS BIGINT) + 1 END AS params
  FROM supplier
)"""

# Examples with nine 0/1 traits; predictions flip one trait of some rows.
TRAITS = """
traits AS (
  SELECT task_name, model_ckpt, img_id, j AS trait, y_true,
         CASE WHEN j = h % 9 AND h >= 30 + 5 * k THEN 1 - y_true ELSE y_true END AS y_pred
  FROM (
    SELECT o_orderstatus AS task_name, 'm' || k AS model_ckpt, CAST(o_orderkey AS VARCHAR) AS img_id, k, j,
           CAST((o_custkey >> j) & 1 AS INTEGER) AS y_true, (o_orderkey * 31 + k * 17) % 100 AS h
    FROM orders, (SELECT unnest(range(8)) AS k), (SELECT unnest(range(9)) AS j)
  )
)"""

UNIT_VECTORS = """
dims64 AS (SELECT unnest(range(1, 65)) AS j),
elems AS (
  SELECT vec_id, label, j, CAST(embedding[j] AS DOUBLE) AS x FROM embeddings, dims64
)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _with_models(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))).alias("k"))
    return rows.withColumns(
        {
            "task_name": F.col("o_orderstatus"),
            "model_ckpt": F.concat(F.lit("m"), F.col("k").cast("string")),
            "img_id": F.col("o_orderkey").cast("string"),
            "h": (F.col("o_orderkey") * 31 + F.col("k") * 17) % 100,
        }
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(task_name, model_ckpt, img_id, k, y_true, y_pred, score)``."""
    rows = _with_models(table(spark, sf, "orders"))
    y_true = (F.col("o_custkey") % CLASSES).cast("int")
    wrong = ((F.col("y_true") + 1 + F.col("h") % 19) % CLASSES).cast("int")
    rows = rows.withColumn("y_true", y_true)
    rows = rows.withColumn("y_pred", F.when(F.col("h") < 40 + 5 * F.col("k"), F.col("y_true")).otherwise(wrong))
    rows = rows.withColumn("score", (F.col("y_pred") == F.col("y_true")).cast("double"))
    return rows.select("task_name", "model_ckpt", "img_id", "k", "y_true", "y_pred", "score")


def unknown_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions in which label 0 is the unknown class -1."""
    rows = predictions(spark, sf)
    return rows.withColumns({c: F.when(F.col(c) == 0, -1).otherwise(F.col(c)) for c in ("y_true", "y_pred")})


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions as stored: labels only in JSON; models m1 and m3 use the other key names."""
    rows = predictions(spark, sf)
    usual = F.to_json(F.struct("y_true", "y_pred"))
    other = F.to_json(F.struct(F.col("y_true").alias("true_y"), F.col("y_pred").alias("pred_y")))
    info = F.when(F.col("k").isin(1, 3), other).otherwise(usual)
    return rows.select("img_id", "score", info.alias("info"), experiment_id().alias("experiment_id"))


def experiment_id():
    return (F.col("k") * 100 + F.ascii("task_name")).cast("bigint")


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """One row per task and model; model m7 was trained on 100 examples only."""
    rows = predictions(spark, sf).select("task_name", "model_ckpt", "k").distinct()
    n_train = F.when(F.col("k") == 7, 100).otherwise(-1)
    return rows.select(experiment_id().alias("id"), "task_name", "model_ckpt", n_train.alias("n_train"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``(task, model, mean)`` of suppliers."""
    rows = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("task"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("model")
    )
    return rows.agg(F.round(F.avg("l_discount"), 9).alias("mean"))


def complete(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with a score on all tasks, as columns, and their mean."""
    wide = scores(spark, sf).groupBy("model").pivot("task", TASKS).agg(F.first("mean")).dropna(subset=TASKS)
    return wide.withColumn("mean", (F.col("A") + F.col("N") + F.col("R")) / 3)


def dims(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier attributes ``(model_ckpt, family, resolution, params)``."""
    part = F.col("s_nationkey") % 3
    size = F.floor((F.col("s_acctbal") + 1000) * 200000).cast("bigint") + 1
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("model_ckpt"),
        F.concat(F.lit("f"), part.cast("string")).alias("family"),
        F.when(part == 0, 224).when(part == 1, 256).otherwise(384).alias("resolution"),
        F.when(F.col("s_suppkey") == 5, F.lit(50_000_000).cast("bigint")).otherwise(size).alias("params"),
    )


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """``(task_name, model_ckpt, img_id, y_true, y_pred)`` with nine 0/1 labels per row."""
    rows = _with_models(table(spark, sf, "orders"))
    rows = rows.withColumn("y_true", F.array(*[(F.shiftright("o_custkey", j) % 2).cast("int") for j in range(9)]))
    flips = F.col("h") >= 30 + 5 * F.col("k")
    pred = F.transform("y_true", lambda y, j: F.when((j == F.col("h") % 9) & flips, 1 - y).otherwise(y))
    return rows.select("task_name", "model_ckpt", "img_id", "y_true", pred.alias("y_pred"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, embedding, label)``."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as video frames: ``(video_id, ts_key, event_id, label)``."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), "ts", "event_id", F.col("event_type").alias("label"), "value"
    )


def run_times(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: customer is the model, priority the task, order date the time."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model_ckpt"),
        F.col("o_orderpriority").alias("task_name"),
        F.round(F.col("o_totalprice"), 2).alias("mean_score"),
        F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("posix"),
    )
