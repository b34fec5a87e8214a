"""Seeded sampling. Rows are ordered by a hash of (seed, id), so a retry picks the same rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import BITS, hash_grid, hash_long
from evalspark.functions.labels import UNKNOWN
from evalspark.operators.costs import ERROR_BITS, pooled_user_loss
from evalspark.operators.joint import added
from evalspark.scaling import MODEL_BYTES, explode_range, group_rank, setting


def _shuffled(df: DataFrame, seed: int, id_col: str, tag: str) -> DataFrame:
    return df.withColumn("_h", hash_long(seed, tag, F.col(id_col)))


def _share(wanted: Column, have: Column) -> Column:
    """Share of the hash range that holds the ``wanted`` lowest of ``have`` rows, with a wide margin."""
    return F.least(F.lit(1.0), (wanted + 8 * F.sqrt(wanted) + 32) / have)


def _lowest(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can be among the ``_quota`` lowest hashes of their group of ``_have`` rows.

    Only a sample-sized part of the data is shuffled afterwards. The part is checked by
    a count; should any group hold too few rows, nothing is cut away.
    """
    low = F.col("_h") <= F.col("_share") * float(2**BITS)
    held = marked.groupBy(*keys).agg(
        F.count_if(low).alias("_c"), F.min(F.least("_quota", "_have")).alias("_need")
    )
    return marked.where(low) if held.where("_c < _need").isEmpty() else marked


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Simple random sample of n rows without replacement (all rows if fewer)."""
    total = F.lit(df.count())
    rows = _shuffled(df, seed, id_col, "simple")
    marked = rows.withColumns({"_quota": F.lit(n), "_have": total, "_share": _share(F.lit(n), total)})
    ranked = group_rank(_lowest(marked, []), [], ["_h", id_col], "_r")
    return ranked.where(F.col("_r") <= n).select(*df.columns)


def balanced_sample(df: DataFrame, label: str, n: int, seed: int, id_col: str) -> DataFrame:
    """Random sample of n rows, as even over the classes as the data allows.

    Every class gets n // k rows; the remainder goes to classes in hashed order, one
    each. What small classes cannot supply is drawn from the rows not yet chosen.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_have"))
    classes = classes.withColumn("_ch", hash_long(seed, "class", F.col(label)))
    classes = group_rank(classes, [], ["_ch", label], "_c", size="_k")
    base = F.floor(F.lit(n) / F.col("_k"))
    quota = (base + F.when(F.col("_c") <= n - base * F.col("_k"), 1).otherwise(0)).cast("bigint")
    classes = classes.select(label, quota.alias("_quota"), "_have")
    totals = classes.agg(
        F.coalesce(F.sum(F.least("_quota", "_have")), F.lit(0)).alias("chosen"),
        F.coalesce(F.sum(F.when(F.col("_have") > F.col("_quota"), F.col("_have"))), F.lit(0)).alias("large"),
        F.coalesce(F.sum(F.when(F.col("_have") > F.col("_quota"), F.col("_quota"))), F.lit(0)).alias("taken"),
    ).first()
    missing = max(n - totals["chosen"], 0)
    share = _share(F.col("_quota"), F.col("_have"))
    if missing and totals["large"]:
        # Low rows of the large classes beyond their quota fill the gap.
        gap = F.lit(totals["taken"] + missing)
        share = F.greatest(share, _share(gap, F.lit(totals["large"])))
    rows = _shuffled(df, seed, id_col, "row")
    marked = rows.join(classes.withColumn("_share", share), label)
    ranked = group_rank(_lowest(marked, [label]), [label], ["_h", id_col], "_r")
    inside = ranked.where(F.col("_r") <= F.col("_quota")).select(*df.columns)
    if not missing:
        return inside
    rest = ranked.where(F.col("_r") > F.col("_quota"))
    if rest.count() < min(missing, totals["large"] - totals["taken"]):
        rest = group_rank(marked, [label], ["_h", id_col], "_r").where(F.col("_r") > F.col("_quota"))
    filled = group_rank(rest.withColumnRenamed("_r", "_in_class"), [], ["_h", id_col], "_r")
    return inside.unionByName(filled.where(F.col("_r") <= missing).select(*df.columns))


def stratified_sample(
    df: DataFrame, n: int, seed: int, id_col: str, task: str = "task", label: str = "label", split: str = "split"
) -> DataFrame:
    """Training rows cut to n per task, n // 2 of label 0 and the rest of label 1.

    Other splits stay whole, a stratum with too few rows is kept whole, and n <= 0
    returns everything.
    """
    if n <= 0:
        return df
    if n < 2:
        raise ValueError("both labels need at least one row")
    is_train = F.col(split) == "train"
    train = df.where(is_train)
    quota = F.when(F.col(label) == 0, n // 2).when(F.col(label) == 1, n - n // 2)
    strata = train.groupBy(task, label).agg(F.count(F.lit(1)).alias("_have")).withColumn("_quota", quota)
    strata = strata.dropna(subset=["_quota"]).withColumn("_share", _share(F.col("_quota"), F.col("_have")))
    marked = _shuffled(train, seed, id_col, "stratum").join(strata, [task, label])
    ranked = group_rank(_lowest(marked, [task, label]), [task, label], ["_h", id_col], "_r")
    kept = ranked.where(F.col("_r") <= F.col("_quota")).select(*df.columns)
    return df.where(F.coalesce(~is_train, F.lit(True))).unionByName(kept)


def temporal_split(
    df: DataFrame, keys: list[str], order: list[Column | str], train_share: float = 0.8, name: str = "split"
) -> DataFrame:
    """Earliest share of each group is ``train``, the rest ``val``. ``order`` ends with an id."""
    ranked = group_rank(df, keys, order, "_r", size="_n")
    is_train = F.col("_r") <= F.floor(F.lit(train_share) * F.col("_n"))
    return ranked.withColumn(name, F.when(is_train, "train").otherwise("val")).drop("_r", "_n")


def split_frames(df: DataFrame, split: str = "split", train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Training rows and all other rows."""
    is_train = F.coalesce(F.col(split) == train, F.lit(False))
    return df.where(is_train), df.where(~is_train)


def random_labels(test: DataFrame, train: DataFrame, trials: int, seed: int, id_col: str, label: str = "label", uniform: bool = False) -> DataFrame:
    """Chance predictions per trial, drawn from -1 and the training labels.

    By default each training row is one entry of the draw, so common labels are more
    likely; with ``uniform`` each distinct label is one entry.
    """
    pool = train.select(F.col(label).alias("y_pred"))
    pool = pool.distinct() if uniform else pool
    counts = pool.groupBy("y_pred").agg(F.count(F.lit(1)).alias("_n"))
    # Labels are looked up by position; position 0 is the unknown label.
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    ends = _running_total(counts, "y_pred", "_n")
    positions = explode_range(ends, F.col("_end") - F.col("_n") + 1, F.col("_end"), "_p").select("_p", "y_pred")
    rows = test.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = rows.withColumn("_p", F.pmod(hash_long(seed, F.col("trial"), F.col(id_col)), total + 1))
    return (
        drawn.join(positions, "_p", "left")
        .withColumn("y_pred", F.coalesce("y_pred", F.lit(-1)))
        .drop("_p")
    )


def _running_total(counts: DataFrame, order: str, n: str) -> DataFrame:
    """Running total of ``n`` over all rows in ``order``; one row per distinct label comes in."""
    from pyspark.sql import Window

    block = 4096
    ranked = group_rank(counts, [], [order], "_r").withColumn("_b", F.floor((F.col("_r") - 1) / block))
    inner = Window.partitionBy("_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_in", F.sum(n).over(inner))
    blocks = ranked.groupBy("_b").agg(F.sum(n).alias("_s"))
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_off"))
    return ranked.join(blocks, "_b").withColumn("_end", F.col("_in") + F.col("_off")).drop("_in", "_off", "_b", "_r")


def random_bits(test: DataFrame, traits: int, trials: int, seed: int, id_col: str) -> DataFrame:
    """Chance multi-label predictions: each trait is a fair coin per trial."""
    rows = test.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    bits = [F.pmod(hash_long(seed, F.col("trial"), F.col(id_col), j), F.lit(2)).cast("int") for j in range(traits)]
    return rows.withColumn("y_pred", F.array(*bits))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores; each stands for far more work than its size tells."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def chance_user_loss(
    test: DataFrame, train: DataFrame, trials: int, seed: int, id_col: str, harmful: Iterable[int], label: str = "label", truth: str = "y_true"
) -> DataFrame:
    """(trial, value): normalised user loss of predictions drawn as in ``random_labels``.

    A task draws all trials of a row at once, finds the labels in the running total of the label counts, and adds up how
    many rows of each kind a trial has; neither test rows nor training rows are repeated.
    """
    counts = train.groupBy(F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v")
    known = counts.count()
    if 16 * known > setting(train.sparkSession, "modelBytes", MODEL_BYTES):
        raise ValueError(f"{known} labels are too many for a table in every task")
    found = counts.collect()
    labels, ends = np.array([UNKNOWN, *(r["v"] for r in found)], np.int64), np.cumsum([r["n"] for r in found])
    bad, total = np.array(sorted(harmful), np.int64), int(ends[-1]) if len(ends) else 0
    rows = test.select(F.col(id_col).cast("string").alias("id"), F.col(truth).cast("bigint").alias("t"))

    def kinds(c: dict[str, np.ndarray]) -> np.ndarray:
        drawn = hash_grid([f"{seed}-{t}" for t in range(trials)], c["id"].tolist()) % (total + 1)
        pred, true = labels[np.where(drawn > 0, np.searchsorted(ends, drawn) + 1, 0)], c["t"][None, :]
        new, said = true == UNKNOWN, pred == UNKNOWN
        harm, alarm = np.isin(true, bad), np.isin(pred, bad)
        flags = [(true != pred) & ~new & ~said, new & ~said, ~new & said, harm & ~alarm, ~harm & alarm, new, harm]
        return np.stack([np.broadcast_to(f, pred.shape).sum(axis=1) for f in flags] + [np.full(trials, pred.shape[1])])

    sums = added(_spread(rows.where("t IS NOT NULL")), kinds, 1024)
    values = pooled_user_loss(sums.reshape(len(ERROR_BITS) + 1, trials)) if len(sums) else []
    return test.sparkSession.createDataFrame([(t, float(v)) for t, v in enumerate(values)], "trial int, value double")


def chance_multilabel(test: DataFrame, traits: int, trials: int, seed: int, id_col: str, truth: str = "y_true") -> DataFrame:
    """(trial, value): macro F1 over {0, 1}, averaged over the traits, of fair coins as in ``random_bits``."""
    rows = test.select(F.col(id_col).cast("string").alias("id"), F.col(truth).cast("array<double>").alias("t"))

    def cells(c: dict[str, np.ndarray]) -> np.ndarray:
        names, true = [f"{i}-{j}" for j in range(traits) for i in c["id"].tolist()], c["t"][:, :traits]
        is_ = np.stack([true == 0, true == 1]).astype(np.float32)
        out = np.zeros((2, 3, trials, traits))
        for k in range(0, trials, 32):
            some = range(k, min(k + 32, trials))
            coins = (hash_grid([f"{seed}-{t}" for t in some], names) & 1).astype(np.float32).reshape(len(some), traits, -1)
            # Heads among the rows of each label, as products; the rest are tails.
            heads = np.stack([[coins[:, j] @ is_[v, :, j] for j in range(traits)] for v in (0, 1)]).transpose(0, 2, 1)
            said, part = coins.sum(axis=2), slice(some.start, some.stop)
            out[:, 0, part] = is_[0].sum(axis=0) - heads[0], heads[1]
            out[:, 1, part] = is_.sum(axis=1)[:, None]
            out[:, 2, part] = len(true) - said, said
        return out

    sums = added(_spread(rows), cells, 2048)
    if not len(sums):
        return test.sparkSession.createDataFrame([], "trial int, value double")
    hits, true, said = np.moveaxis(sums.reshape(2, 3, trials, traits), 1, 0)
    f1 = np.divide(2 * hits, true + said, out=np.zeros_like(hits), where=true + said > 0)
    values = (f1.sum(axis=0) / 2).mean(axis=1)
    return test.sparkSession.createDataFrame([(t, float(v)) for t, v in enumerate(values)], "trial int, value double")


def baseline_summary(per_trial: DataFrame) -> DataFrame:
    """Mean and population deviation of a score over trials, in percent."""
    score = F.col("value") * 100
    return per_trial.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
