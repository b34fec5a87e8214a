"""Scores over predictions ``(keys…, img_id, score, y_true, y_pred)``.

Every function groups by ``by`` and returns those columns plus ``value``. An
optional ``weight`` column counts a row several times (or not at all), which is how
the resampling operators reuse the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def mean_score(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean of the score column."""
    w = _weight(weight)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col("score") * w), F.sum(w)).alias("value"))


def micro_acc(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Share of rows whose prediction equals the truth."""
    w = _weight(weight)
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.sum(hit * w), F.sum(w)).alias("value"))


def macro_acc(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    recall = micro_acc(df, [*by, "y_true"], weight)
    return recall.groupBy(*by).agg(F.avg("value").alias("value"))


def cells(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Summed weight ``w`` per (truth, prediction) pair.

    Rows are added up before any shuffle, so a class that holds most rows costs one
    partial row per task.
    """
    return df.groupBy(*by, "y_true", "y_pred").agg(F.sum(_weight(weight)).alias("w"))


def class_counts(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """True-positive, truth and prediction counts per class.

    Only the cells are split into a truth entry and a prediction entry, never the rows.
    """
    hit = F.col("y_true") == F.col("y_pred")
    w, zero = F.col("w"), F.lit(0.0)
    entry = F.explode(
        F.array(
            F.struct(F.col("y_true").alias("label"), w.alias("t"), zero.alias("p"),
                     F.when(hit, w).otherwise(zero).alias("tp")),
            F.struct(F.col("y_pred").alias("label"), zero.alias("t"), w.alias("p"), zero.alias("tp")),
        )
    )
    return (
        cells(df, by, weight)
        .select(*by, entry.alias("e"))
        .groupBy(*by, F.col("e.label").alias("label"))
        .agg(
            F.sum("e.tp").alias("tp"),
            F.sum("e.t").alias("n_true"),
            F.sum("e.p").alias("n_pred"),
        )
    )


def summary(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and dense macro F1 from one pass over the rows."""
    total = F.col("n_true") + F.col("n_pred")
    f1 = F.when(total > 0, 2 * F.col("tp") / total)
    return class_counts(df, by, weight).groupBy(*by).agg(
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("micro_acc"),
        F.avg(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))).alias("macro_acc"),
        (F.sum(f1) / (F.max("label") + 1)).alias("macro_f1"),
    )


def micro_f1(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """F1 of the summed counts."""
    counts = class_counts(df, by, weight)
    return counts.groupBy(*by).agg(
        F.try_divide(2 * F.sum("tp"), F.sum("n_true") + F.sum("n_pred")).alias("value")
    )


def macro_f1(
    df: DataFrame,
    by: list[str],
    weight: str | None = None,
    n_classes: int | str | None = None,
    present_only: bool = False,
) -> DataFrame:
    """Mean F1 over classes.

    By default the classes are 0..largest label seen, and absent classes count as 0.
    ``n_classes`` fixes the count (a number, or a column in ``by``); ``present_only``
    averages only over classes that occur in the truth or the predictions.
    """
    counts = class_counts(df, by, weight)
    total = F.col("n_true") + F.col("n_pred")
    f1 = F.when(total > 0, 2 * F.col("tp") / total)
    if present_only:
        value = F.avg(f1)
    elif isinstance(n_classes, str):
        value = F.sum(f1) / F.first(n_classes)
    elif n_classes is not None:
        value = F.sum(f1) / F.lit(n_classes)
    else:
        value = F.sum(f1) / (F.max("label") + 1)
    return counts.groupBy(*by).agg(F.coalesce(value, F.lit(0.0)).alias("value"))


def multilabel_rows(df: DataFrame) -> DataFrame:
    """One row per trait of array labels ``y_true`` and ``y_pred``."""
    pairs = F.posexplode(F.arrays_zip(F.col("y_true"), F.col("y_pred"))).alias("trait", "pair")
    rest = [c for c in df.columns if c not in ("y_true", "y_pred")]
    return df.select(*rest, pairs).select(*rest, "trait", "pair.y_true", "pair.y_pred")


def multilabel_macro_f1(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Macro F1 over {0, 1} per trait, averaged over the traits."""
    per_trait = macro_f1(multilabel_rows(df), [*by, "trait"], weight, n_classes=2)
    return per_trait.groupBy(*by).agg(F.avg("value").alias("value"))


def check_equal_n(df: DataFrame, by: list[str]) -> DataFrame:
    """Smallest and largest group size; the two differ when predictions are missing."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        (F.min("n") == F.max("n")).alias("consistent"),
    )


def assert_equal_n(df: DataFrame, by: list[str], within: str | None = None) -> None:
    """Fail when the groups differ in size, or those with the same value of ``within``."""
    if within:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).groupBy(within)
        odd = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo < hi").first()
        if odd:
            raise ValueError(f"{odd[within]} has between {odd['lo']} and {odd['hi']} rows")
        return
    row = check_equal_n(df, by).first()
    if row["min_n"] != row["max_n"]:
        raise ValueError(f"groups have between {row['min_n']} and {row['max_n']} rows")
