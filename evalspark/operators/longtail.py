"""Long-tail statistics of class counts.

Classes of equal size are merged first into ``(f, m)``: m classes have f examples.
Distinct sizes of N examples number at most sqrt(2 N), so running totals over them
stay small however many classes there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.scaling import explode_range


def class_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Examples per class."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def size_table(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Class sizes ``f`` with their number of classes ``m``, and totals over smaller and larger sizes."""
    sizes = counts.where(F.col(n) > 0).groupBy(*by, F.col(n).alias("f")).agg(F.count(F.lit(1)).alias("m"))
    group = Window.partitionBy(*by)
    smaller = group.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    larger = group.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("f") * F.col("m")
    zero = F.lit(0)
    return sizes.select(
        *by,
        "f",
        "m",
        F.coalesce(F.sum(mass).over(smaller), zero).alias("mass_below"),
        F.coalesce(F.sum(mass).over(larger), zero).alias("mass_above"),
        F.coalesce(F.sum("m").over(larger), zero).alias("rank_above"),
        F.sum(mass).over(group).alias("total"),
        F.sum("m").over(group).alias("classes"),
    )


def zipf_exponent(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Minus the slope of log size on log rank, largest class first."""
    sizes = size_table(counts, by, n)
    ranks = explode_range(
        sizes.select(*by, "f", "m", "rank_above"),
        F.col("rank_above") + 1,
        F.col("rank_above") + F.col("m"),
        "_rank",
    )
    slope = F.regr_slope(F.ln("f"), F.ln("_rank"))
    return ranks.groupBy(*by).agg((-slope).alias("value"))


def effective_classes(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Exponential of the entropy of the class shares."""
    sizes = size_table(counts, by, n)
    share = F.col("f") / F.col("total")
    return sizes.groupBy(*by).agg(F.exp(-F.sum(F.col("m") * share * F.ln(share))).alias("value"))


def imbalance_ratio(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Largest class size divided by the smallest."""
    return counts.groupBy(*by).agg((F.max(n) / F.min(n)).alias("value"))


def gini(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """1 - 2 * sum(running share, smallest class first) / (classes + 1)."""
    sizes = size_table(counts, by, n)
    f, m = F.col("f").cast("double"), F.col("m").cast("double")
    running = m * F.col("mass_below") + f * m * (m + 1) / 2
    area = F.sum(running) / F.first("total")
    return sizes.groupBy(*by).agg((1 - 2 * area / (F.first("classes") + 1)).alias("value"))


def tail_mass(counts: DataFrame, by: list[str], share: float = 0.9, n: str = "n") -> DataFrame:
    """Share of classes, largest first, that together hold ``share`` of the examples."""
    sizes = size_table(counts, by, n)
    goal = F.lit(share) * F.col("total")
    # Smallest j in 1..m with mass_above + j f >= goal; the division is checked on both sides.
    guess = F.greatest(F.ceil((goal - F.col("mass_above")) / F.col("f")), F.lit(1))
    sizes = sizes.withColumn("_goal", goal).withColumn("_j", guess)

    def covers(j):
        return F.col("mass_above") + j * F.col("f") >= F.col("_goal")

    j = (
        F.when(~covers(F.col("_j")), F.col("_j") + 1)
        .when((F.col("_j") > 1) & covers(F.col("_j") - 1), F.col("_j") - 1)
        .otherwise(F.col("_j"))
    )
    needed = F.when(j <= F.col("m"), F.col("rank_above") + j)
    return sizes.withColumn("_k", needed).groupBy(*by).agg((F.min("_k") / F.first("classes")).alias("value"))
