"""Running scores while runs append predictions to the results folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.sources.store import PREDICTIONS_SCHEMA


def prediction_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New prediction files of the store as they arrive."""
    return spark.readStream.schema(PREDICTIONS_SCHEMA).parquet(f"{folder}/predictions")


def running_mean(stream: DataFrame) -> DataFrame:
    """Mean score and row count per task and run; the state is one row per run."""
    return stream.groupBy("task_name", "experiment_id").agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")
    )


def start(scores: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and keep the result as a table in memory."""
    writer = scores.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
