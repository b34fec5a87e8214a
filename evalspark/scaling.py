"""Size checks, stable intermediate tables and skew-safe ranking.

Everything here exists so that one hot group (a task, class or video holding a
large share of all rows) never has to fit in one task.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest group that is ranked with one plain window partition.
GROUP_ROWS = 2_000_000
# Rows generated per task-sized piece when a counter range is expanded.
RANGE_STEP = 65_536
# Largest fitted model (centroids, pivots, covariance) held by driver and tasks.
MODEL_BYTES = 256 * 1024 * 1024


def setting(spark: SparkSession, name: str, default: int) -> int:
    """Integer setting ``spark.evalspark.<name>`` of the session, or the default."""
    return int(spark.conf.get(f"spark.evalspark.{name}", str(default)))


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back from there.

    Needed where two later reads must see the same row placement or the same
    random numbers even if an executor is lost in between.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder path beside the checkpoints, visible to every executor."""
    return f"{_ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder, for results that are read several times."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the biggest group; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def group_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    name: str = "rank",
    size: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and optionally the group size.

    ``order`` must be total inside a group (end it with an id). Groups that fit in
    a task use a window. Otherwise, and always without keys, rows are range-partitioned on (keys, order), so
    a hot group spreads over many partitions; the position is then the position
    inside the partition plus the group's row count in earlier partitions.
    ``largest`` is the size of the biggest group where the caller has counted already.
    """
    limit = setting(df.sparkSession, "groupRows", GROUP_ROWS)
    # Without keys a window would be one task.
    if keys and (largest_group(df, keys) if largest is None else largest) <= limit:
        window = Window.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("bigint"))
        if size:
            out = out.withColumn(size, F.count(F.lit(1)).over(window))
        return out
    return _range_rank(df, keys, order, name, size)


def _range_rank(df, keys, order, name, size):
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = stable(placed).withColumn("_part", F.shiftright("_pos", 33))
    pieces = placed.groupBy("_part", *keys).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # A group has at most one piece per partition, so these windows stay small.
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("_part").alias("_p"),
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(group).alias("_total"),
    )
    match = F.col("_part") == F.col("_p")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(pieces, match).withColumn(name, F.col("_pos") + F.col("_shift"))
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.select(*df.columns, name, *([size] if size else []))


def explode_range(df: DataFrame, first: str | Column, last: str | Column, name: str) -> DataFrame:
    """One row per integer in [first, last]; long ranges are cut and spread over tasks."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    first, last = first.cast("bigint"), last.cast("bigint")
    spark = df.sparkSession
    # A fixed number, since these few rows would otherwise be merged into one task.
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    cut = (
        df.where(last >= first)
        .withColumn("_last", last)
        .withColumn("_start", F.explode(F.sequence(first, last, F.lit(RANGE_STEP).cast("bigint"))))
        .repartition(pieces, "_start", *keys)
    )
    stop = F.least(F.col("_start") + RANGE_STEP - 1, F.col("_last"))
    return cut.withColumn(name, F.explode(F.sequence("_start", stop))).drop("_start", "_last")
