"""Paired bootstrap of any metric, and the tests built on it.

Two ways to resample. ``multinomial`` draws n of n example ids with replacement,
once per task and replicate, and every model uses the same draw. ``poisson`` gives
each example an independent Poisson(1) count from a hash of its id: the counts need
no draw table and no join, so it is the one to use on very large tables.

The metrics of the report are computed from count arrays (``counts``). ``bootstrap``
takes any other metric that has a weight column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from evalspark.functions.draws import hash_index, hash_long, poisson_count, poisson_limits
from evalspark.functions.vectors import list_column
from evalspark.operators import costs, counts
from evalspark.scaling import explode_range, group_rank

TASK, MODEL, ID = "task_name", "model_ckpt", "img_id"
REPLICATE = "replicate"
# Counts held at once by one Arrow step (8 bytes each).
BATCH_CELLS = 4_000_000


def dedup_predictions(df: DataFrame) -> DataFrame:
    """One row per (task, model, example, prediction)."""
    return df.dropDuplicates([TASK, MODEL, ID, *[c for c in ("score", "y_true", "y_pred") if c in df.columns]])


def by_example(df: DataFrame) -> DataFrame:
    """One row per (task, example) with the predictions of all models in ``_rows``.

    The array holds one entry per model, so its length is the number of models. It
    lets each draw be made once for all of them, and spreads the rows over all tasks
    before they are multiplied by the number of replicates.
    """
    rest = [c for c in df.columns if c not in (TASK, ID)]
    return df.groupBy(TASK, ID).agg(F.collect_list(F.struct(*rest)).alias("_rows"))


def task_sizes(df: DataFrame) -> dict[str, int]:
    """Number of distinct examples per task."""
    return {row[0]: row[1] for row in df.groupBy(TASK).agg(F.count_distinct(ID)).collect()}


def example_positions(examples: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Position of each example of a task in id order."""
    placed = group_rank(examples, [TASK], [ID], "_i", largest=max(sizes.values(), default=0))
    return placed.withColumn("_p", F.col("_i") - 1).drop("_i")


def draws(spark: SparkSession, sizes: dict[str, int], b: int, seed: int) -> DataFrame:
    """All draws ``(task_name, replicate, _p)``, shuffled once on (task, position).

    Slot s of a replicate picks position ``hash(seed, task, replicate, s) mod n``. The
    groupings and the join that follow use the same partitioning.
    """
    tasks = spark.createDataFrame(sorted(sizes.items()), f"{TASK} string, _n bigint")
    replicates = tasks.withColumn(REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    slots = explode_range(replicates, F.lit(0), F.col("_n") - 1, "_slot")
    position = hash_index(F.col("_n"), seed, F.col(TASK), F.col(REPLICATE), F.col("_slot"))
    return slots.select(TASK, REPLICATE, position.alias("_p")).repartition(TASK, "_p")


def replicate_rows(df: DataFrame, b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Prediction rows repeated per replicate with their count ``w``.

    Rows that a replicate does not draw are absent (multinomial) or have count 0 (poisson).
    """
    if method == "poisson":
        drawn = by_example(df).withColumn(REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        drawn = drawn.withColumn("_draw", hash_long(seed, F.col(TASK), F.col(REPLICATE), F.col(ID)))
        drawn = drawn.withColumn("w", poisson_count("_draw"))
    elif method == "multinomial":
        sizes = task_sizes(df)
        placed = example_positions(by_example(df), sizes)
        counts = draws(df.sparkSession, sizes, b, seed).groupBy(TASK, "_p", REPLICATE).agg(F.count(F.lit(1)).alias("w"))
        drawn = placed.join(counts, [TASK, "_p"])
    else:
        raise ValueError(f"unknown resampling method {method!r}")
    return drawn.select(TASK, ID, REPLICATE, "w", F.inline("_rows"))


def _add_up(names: list[str], b: int, limits: list[int] | None):
    """Arrow step: sum each example's replicate counts over rows that agree in ``names``.

    A batch's counts form a matrix (examples x replicates); rows of one model and label
    pair are added in one step instead of being repeated per replicate.
    """

    def counts_of(drawn: pa.ListArray) -> np.ndarray:
        flat = drawn.flatten().to_numpy(zero_copy_only=False)
        if limits is not None:
            return np.searchsorted(np.array(limits), flat, side="right").reshape(-1, b)
        place = drawn.value_parent_indices().to_numpy().astype(np.int64) * b + flat
        return np.bincount(place, minlength=len(drawn) * b).reshape(-1, b)

    def add(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = part.column("_rows")
        parent = rows.value_parent_indices()
        flat = rows.flatten()
        keys = {TASK: part.column(TASK).take(parent)} | {n: flat.field(n) for n in names if n != TASK}
        group = pa.table(keys).to_pandas().groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        counts = counts_of(part.column("_draws"))
        sums = np.add.reduceat(counts[parent.to_numpy()[order]], starts, axis=0)
        first = pa.array(order[starts])
        columns = [keys[n].take(first) for n in names] + [list_column(sums.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "_w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                # About BATCH_CELLS counts at a time, whatever the number of models.
                models = max(len(batch.column("_rows")[done]), 1)
                step = max(1, BATCH_CELLS // (b * models))
                yield add(batch.slice(done, step))
                done += step

    return run


def replicate_cells(df: DataFrame, columns: list[str], b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Counts ``w`` per (task, model, replicate, columns), partly added up in each task.

    The draws are those of ``replicate_rows``. Metrics that read only ``columns`` give
    the same result on these rows, of which there are far fewer.
    """
    names = [TASK, MODEL, *columns]
    rows = df.select(TASK, MODEL, ID, *columns)
    if method == "poisson":
        each = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda r: hash_long(seed, F.col(TASK), r, F.col(ID)))
        fed = by_example(rows).withColumn("_draws", each)
    elif method == "multinomial":
        sizes = task_sizes(rows)
        placed = example_positions(by_example(rows), sizes)
        # A position is drawn b times on average, so these lists stay near that length.
        lists = draws(df.sparkSession, sizes, b, seed).groupBy(TASK, "_p").agg(F.collect_list(REPLICATE).alias("_draws"))
        fed = placed.join(lists, [TASK, "_p"])
    else:
        raise ValueError(f"unknown resampling method {method!r}")
    schema = rows.select(*names).schema.add("_w", ArrayType(LongType()))
    step = _add_up(names, b, poisson_limits() if method == "poisson" else None)
    summed = fed.select(TASK, "_rows", "_draws").mapInArrow(step, schema)
    return summed.select(*names, F.posexplode("_w").alias(REPLICATE, "w")).where("w > 0")


def bootstrap(
    df: DataFrame,
    metric: Callable[..., DataFrame],
    b: int,
    seed: int,
    method: str = "multinomial",
    columns: list[str] | None = None,
    **options: object,
) -> DataFrame:
    """Metric per (task, model, replicate).

    ``columns`` names the plain columns the metric reads; without it whole rows are repeated.
    """
    rows = replicate_cells(df, columns, b, seed, method) if columns else replicate_rows(df, b, seed, method)
    found = metric(rows, [TASK, MODEL, REPLICATE], weight="w", **options)
    return complete(found, df, b) if method == "poisson" else found


def complete(replicates: DataFrame, df: DataFrame, b: int) -> DataFrame:
    """All b replicates of every task and model; one that draws no row has a null value."""
    every = df.select(TASK, MODEL).distinct().withColumn(REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return every.join(replicates, [TASK, MODEL, REPLICATE], "left")


def bootstrap_mean(df: DataFrame, b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Replicates of the mean score."""
    return counts.replicates(df, counts.weighted_mean("score"), b, seed, method)


def bootstrap_accuracy(df: DataFrame, b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Replicates of the accuracy."""
    hits = df.withColumn("_hit", (F.col("y_true") == F.col("y_pred")).cast("int"))
    return counts.replicates(hits, counts.weighted_mean("_hit"), b, seed, method)


def bootstrap_macro_f1(
    df: DataFrame, b: int, seed: int, method: str = "multinomial", inner: int = 1
) -> DataFrame:
    """Replicates of the dense macro F1.

    The class count comes from the full data of each model, so a replicate that
    misses the largest label is still divided by the same number. With ``inner``
    above 1 each replicate is the mean of that many draws.
    """
    out = counts.replicates(df, counts.macro_f1(), b * inner, seed, method)
    if inner == 1:
        return out
    grouped = out.withColumn(REPLICATE, F.floor(F.col(REPLICATE) / inner).cast("int"))
    return grouped.groupBy(TASK, MODEL, REPLICATE).agg(F.avg("value").alias("value"))


def bootstrap_multilabel(df: DataFrame, b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Replicates of the multi-label macro F1; whole rows are drawn, with all their traits."""
    both = df.withColumn("_traits", F.to_json(F.struct("y_true", "y_pred")))
    return counts.replicates(both, counts.multilabel_f1(), b, seed, method)


def bootstrap_user_loss(
    df: DataFrame, harmful: Iterable[int] | DataFrame, b: int, seed: int, method: str = "multinomial"
) -> DataFrame:
    """Replicates of the normalised user loss; the largest loss is pooled over replicates."""
    coded = costs.error_codes(df, harmful, "_code")
    statistic = counts.coded(costs.ERROR_BITS, costs.pooled_user_loss, "_code")
    return counts.replicates(coded, statistic, b, seed, method)


def summarize_ci(replicates: DataFrame, alpha: float) -> DataFrame:
    """Bootstrap mean and the (alpha/2, 1 - alpha/2) percentiles per task and model."""
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        replicates.groupBy(TASK, MODEL)
        .agg(F.avg("value").alias("bootstrap_mean"), bounds.alias("_ci"))
        .select(
            TASK,
            MODEL,
            "bootstrap_mean",
            F.get("_ci", F.lit(0)).alias("ci_low"),
            F.get("_ci", F.lit(1)).alias("ci_high"),
        )
    )


def best_model(replicates: DataFrame) -> DataFrame:
    """Model with the highest bootstrap mean per task; the first name wins a tie."""
    means = replicates.groupBy(TASK, MODEL).agg(F.round(F.avg("value"), 12).alias("bootstrap_mean"))
    first = Window.partitionBy(TASK).orderBy(F.desc("bootstrap_mean"), MODEL)
    ranked = means.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return ranked.select(TASK, F.col(MODEL).alias("best"), "bootstrap_mean")


def p_vs_best(replicates: DataFrame) -> DataFrame:
    """One-sided p-value per model: share of replicates that reach the best model's value.

    Values are compared after rounding to 12 digits, since the order in which
    partial sums arrive may change the last digit.
    """
    values = replicates.withColumn("value", F.round("value", 12))
    best = best_model(replicates).select(TASK, F.col("best").alias(MODEL))
    top = values.join(best, [TASK, MODEL]).select(TASK, REPLICATE, F.col("value").alias("_best"))
    reached = (F.col("value") >= F.col("_best")).cast("double")
    return values.join(top, [TASK, REPLICATE]).groupBy(TASK, MODEL).agg(F.avg(reached).alias("p"))


def holm(df: DataFrame, by: list[str], alpha: float, p: str = "p", tie: str = MODEL) -> DataFrame:
    """Holm step-down: adds ``p_adj`` and ``reject``. A family holds one row per model."""
    family = Window.partitionBy(*by)
    ordered = family.orderBy(p, tie)
    scaled = (F.count(F.lit(1)).over(family) - F.row_number().over(ordered) + 1) * F.col(p)
    out = df.withColumn("_scaled", scaled)
    running = F.max("_scaled").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("p_adj", F.least(running, F.lit(1.0))).drop("_scaled")
    return out.withColumn("reject", F.col("p_adj") <= alpha)


def best_and_ties(replicates: DataFrame, alpha: float) -> DataFrame:
    """Best model per task and the sorted models that do not differ from it."""
    tested = holm(p_vs_best(replicates), [TASK], alpha)
    ties = tested.where(~F.col("reject")).groupBy(TASK).agg(F.sort_array(F.collect_list(MODEL)).alias("ties"))
    return best_model(replicates).select(TASK, "best").join(ties, TASK, "left").withColumn(
        "ties", F.coalesce("ties", F.array().cast("array<string>"))
    )
