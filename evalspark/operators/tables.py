"""Filters, joins, label encodings and set operations on labelled tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.scaling import group_rank, materialize


# ---- filters -------------------------------------------------------------


def filter_known(df: DataFrame, tasks: Iterable[str] | None = None, models: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Rows of known tasks and models, from full-data runs when ``n_train`` is present."""
    if "n_train" in df.columns:
        df = df.where(F.col("n_train") == -1)
    if tasks is not None:
        df = df.where(F.col("task_name").isin(list(tasks)))
    if isinstance(models, DataFrame):
        df = df.join(models.select("model_ckpt").distinct(), "model_ckpt", "left_semi")
    elif models is not None:
        df = df.where(F.col("model_ckpt").isin(list(models)))
    return df


def require_all(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in the given columns."""
    return df.dropna(how="any", subset=cols)


def nonempty(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return df.where(F.col(col) != "")


def stale_rows(df: DataFrame, now: float, max_age_hours: int = 72) -> DataFrame:
    """Claims strictly older than the limit."""
    if max_age_hours <= 0:
        raise ValueError("max_age_hours must be positive")
    return df.where(F.col("posix") < F.lit(now - max_age_hours * 3600))


def fresh_rows(df: DataFrame, now: float, max_age_hours: int = 72) -> DataFrame:
    """Claims that stay after the stale ones are cleared."""
    if max_age_hours <= 0:
        raise ValueError("max_age_hours must be positive")
    return df.where(F.col("posix") >= F.lit(now - max_age_hours * 3600))


def flatten_struct(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Replace a struct column by its fields, named ``prefix_field``."""
    fields = [F.col(f"{col}.{name}").alias(f"{prefix}_{name}") for name in df.schema[col].dataType.fieldNames()]
    return df.select(*[c for c in df.columns if c != col], *fields)


# ---- joins ---------------------------------------------------------------


def join_results(experiments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with the task, model and training size of their experiment.

    The experiments are written first: Spark then knows their size and never takes the predictions, whose size it
    underestimates, for the side to broadcast.
    """
    meta = experiments.select(F.col("id").alias("experiment_id"), "task_name", "model_ckpt", "n_train")
    meta = materialize(meta, "experiments")
    extra = [c for c in predictions.columns if c not in ("task_name", "model_ckpt", "n_train")]
    return predictions.select(*extra).join(meta, "experiment_id")


def with_dims(df: DataFrame, models: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Add model and task attributes; unknown names get nulls."""
    if models is not None:
        df = df.join(models, "model_ckpt", "left")
    if tasks is not None:
        df = df.join(tasks, "task_name", "left")
    return df


def flag_ood(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``ood``: the row's class was not seen in training."""
    seen = train.select(F.col(label).alias("_seen")).where(F.col("_seen").isNotNull()).distinct()
    return test.join(seen, F.col(label) == F.col("_seen"), "left").withColumn("ood", F.col("_seen").isNull()).drop("_seen")


def resolve_path(df: DataFrame, files: DataFrame, name: str = "name", file: str = "file", strict: bool = True) -> DataFrame:
    """Add ``path``: the file of exactly that name, else of its lower-case name.

    A missing file fails the job, or gives a null when not strict.
    """
    listed = files.select(F.col(file).alias("_f")).distinct()
    exact = listed.select(F.col("_f").alias("_exact"))
    lower = listed.select(F.col("_f").alias("_lower"))
    out = df.join(exact, F.col(name) == F.col("_exact"), "left")
    out = out.join(lower, F.lower(name) == F.col("_lower"), "left")
    found = F.coalesce("_exact", "_lower")
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("file not found: "), F.col(name))).cast("string"))
    return out.withColumn("path", found).drop("_exact", "_lower")


def match_files(annotations: DataFrame, files: DataFrame, key: str, min_files: int = 1) -> DataFrame:
    """Annotations with their number of files and a ``status``: ok, incomplete or missing."""
    counts = files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"))
    out = annotations.join(counts, key, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    status = F.when(F.col("n_files") == 0, "missing").when(F.col("n_files") < min_files, "incomplete")
    return out.withColumn("status", status.otherwise("ok"))


def expand_grid(models: DataFrame, axes: dict[str, list], data: dict[str, str] | None = None) -> DataFrame:
    """One row per model and combination of axis values; single values need not be lists.

    The axes are short configuration lists, so each is exploded in place.
    """
    for name, values in axes.items():
        values = values if isinstance(values, list) else [values]
        models = models.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    if data is not None:
        models = models.withColumn("data", F.create_map(*[F.lit(x) for kv in data.items() for x in kv]))
    return models


# ---- labels, indexes, sets -----------------------------------------------


def with_index(df: DataFrame, order: list[Column | str], name: str = "index", keys: list[str] | None = None) -> DataFrame:
    """0-based row index in the given order, over all rows or per group."""
    ranked = group_rank(df, keys or [], order, name)
    return ranked.withColumn(name, F.col(name) - 1)


def label_codes(df: DataFrame, label: str, order: str = "value", arrival: str | None = None) -> DataFrame:
    """Dense code per distinct label, by sorted value or by first arrival."""
    if order == "first":
        seen = df.groupBy(label).agg(F.min(arrival).alias("_seen"))
        codes = with_index(seen, ["_seen", label], "code")
    else:
        codes = with_index(df.select(label).distinct(), [label], "code")
    return codes.select(label, F.col("code").cast("int").alias("code"))


def encode_labels(df: DataFrame, label: str, out: str = "y", order: str = "value", arrival: str | None = None) -> DataFrame:
    """Replace text labels by dense codes."""
    codes = label_codes(df, label, order, arrival).withColumnRenamed("code", out)
    return df.join(codes, label)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (k * class count) for each row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    share = totals.select((F.col("n") / F.col("k")).alias("s")).scalar()
    weights = counts.select(label, (share / F.col("_n")).alias(out))
    return df.join(weights, label)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unknown_models(df: DataFrame, models: DataFrame) -> DataFrame:
    """Stored checkpoints that are not registered."""
    return df.select("model_ckpt").distinct().join(models.select("model_ckpt"), "model_ckpt", "left_anti")


def common_tasks(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Selected tasks that are also benchmark tasks."""
    return selected.select("task_name").intersect(known.select("task_name"))


def label_universe(train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """Distinct labels of both splits."""
    return train.select(label).union(val.select(label)).distinct()


def latest(df: DataFrame, keys: list[str], value: str, posix: str = "posix", tie: str = "id") -> DataFrame:
    """Value of the newest row per key; the larger tie column wins among equal times."""
    newest = F.max_by(F.struct(value, posix), F.struct(F.col(posix), F.col(tie)))
    return df.groupBy(*keys).agg(newest.alias("_l")).select(*keys, f"_l.{value}", f"_l.{posix}")


def audit_md5(files: DataFrame, manifest: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Compare the md5 of each listed file with the manifest: ok, mismatch, missing or unlisted."""
    found = files.select(name, F.md5(F.col(content).cast("binary")).alias("actual"))
    both = manifest.select(name, F.col("md5").alias("expected")).join(found, name, "full")
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "unlisted")
        .when(F.lower("expected") == F.col("actual"), "ok")
        .otherwise("mismatch")
    )
    return both.withColumn("status", status)


def top_n(df: DataFrame, by: Column, n: int, tie: str) -> DataFrame:
    """The n rows with the largest value."""
    return df.orderBy(by.desc_nulls_last(), tie).limit(n)


def align(df: DataFrame, keys: list[str], id_col: str, value: str) -> DataFrame:
    """Values in id order with their position, the same for every key group."""
    return with_index(df.select(*keys, id_col, value), [id_col], "position", keys)
