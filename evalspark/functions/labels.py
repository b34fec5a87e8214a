"""Label parsing and strict encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON keys under which stored predictions keep their labels.
TRUE_KEYS = ("y_true", "true_y")
PRED_KEYS = ("y_pred", "pred_y")
# Fixed value: the label of every class that was not seen in training.
UNKNOWN = -1


def parse_info(df: DataFrame, info: str = "info", ood: bool = False) -> DataFrame:
    """Add ``y_true`` and ``y_pred`` strings read from the JSON column, and ``ood`` (false if absent) where asked for.

    The text is parsed once for all keys; the first key that is present wins.
    """
    keys = TRUE_KEYS + PRED_KEYS + (("ood",) if ood else ())
    parsed = df.withColumn("_info", F.from_json(info, ", ".join(f"{key} string" for key in keys)))
    first = {
        name: F.coalesce(*[F.col(f"_info.{key}") for key in options])
        for name, options in (("y_true", TRUE_KEYS), ("y_pred", PRED_KEYS))
    }
    if ood:
        first["ood"] = F.coalesce(F.col("_info.ood").try_cast("boolean"), F.lit(False))
    return parsed.withColumns(first).drop("_info")


def cast_label(label: Column) -> Column:
    """Text label to integer through float, so ``3.0`` is accepted."""
    return label.cast("float").cast("int")


def correctness(y_pred: str = "y_pred", y_true: str = "y_true") -> Column:
    """1.0 where the prediction equals the truth, else 0.0."""
    return (F.col(y_pred) == F.col(y_true)).cast("double")


def encode_binary(value: Column, positive: str, negative: str, strict: bool = True) -> Column:
    """1 for ``positive`` and 0 for ``negative``.

    The strict form fails on any other value. The lenient form maps every value
    that is not ``negative`` to 1.
    """
    if not strict:
        return F.when(value == negative, 0).otherwise(1)
    message = F.concat(F.lit(f"expected {positive} or {negative}, got "), F.coalesce(value, F.lit("null")))
    return (
        F.when(value == positive, 1)
        .when(value == negative, 0)
        .otherwise(F.raise_error(message).cast("int"))
    )
