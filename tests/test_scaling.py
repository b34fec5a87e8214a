"""The large-data path of each size-checked helper gives the same rows as the small one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_long, poisson_count
from evalspark.operators import rankstats, sampling, sequences, tables
from evalspark.scaling import RANGE_STEP, explode_range, group_rank


def skewed(spark, n=3000):
    """A third of the rows in one group, some null keys, many equal order values."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    return spark.range(n).select("id", key.alias("key"), (F.col("id") * 7 % 11).alias("v"))


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_range_ranking_equals_window(spark, limits, keys):
    df = skewed(spark)
    small = {(r["id"]): (r["rank"], r["n"]) for r in group_rank(df, keys, ["v", "id"], size="n").collect()}
    limits("groupRows", 10)
    large = {(r["id"]): (r["rank"], r["n"]) for r in group_rank(df, keys, ["v", "id"], size="n").collect()}
    assert large == small and len(large) == 3000


def test_range_ranking_keeps_descending_order(spark, limits):
    df = skewed(spark)
    small = sorted(map(tuple, group_rank(df, ["key"], [F.desc("v"), F.asc("id")]).select("id", "rank").collect()))
    limits("groupRows", 10)
    assert sorted(map(tuple, group_rank(df, ["key"], [F.desc("v"), F.asc("id")]).select("id", "rank").collect())) == small


def test_operators_agree_on_both_paths(spark, limits):
    df = skewed(spark).fillna("none")
    ops = {
        "temporal": lambda: sampling.temporal_split(df, ["key"], ["v", "id"]).select("id", "split"),
        "balanced": lambda: sampling.balanced_sample(df, "key", 500, 3, "id").select("id"),
        "simple": lambda: sampling.sample_n(df, 200, 3, "id").select("id"),
        "clip": lambda: sequences.sample_clip(df, "key", ["v", "id"], 16, 5, 1).select("id", "clip_pos"),
        "codes": lambda: tables.encode_labels(df, "key").select("id", "y"),
        "tau": lambda: rankstats.kendall_tau(df, [], "v", "id", "id").select(F.round("value", 12)),
    }
    small = {name: sorted(map(tuple, op().collect())) for name, op in ops.items()}
    limits("groupRows", 10)
    for name, op in ops.items():
        assert sorted(map(tuple, op().collect())) == small[name], name


def test_long_ranges_are_whole(spark):
    df = spark.createDataFrame([("a", 5, RANGE_STEP * 2 + 9), ("b", 1, 0), ("c", 7, 7)], "k string, lo bigint, hi bigint")
    out = explode_range(df, "lo", "hi", "i")
    stats = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in out.groupBy("k").agg(F.count_distinct("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert stats == {"a": (RANGE_STEP * 2 + 5, 5, RANGE_STEP * 2 + 9), "c": (1, 7, 7)}


def test_poisson_counts_have_unit_mean_and_variance(spark):
    draws = spark.range(200_000).withColumn("d", hash_long(1, F.col("id"))).select(poisson_count("d").alias("w"))
    row = draws.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert row["m"] == pytest.approx(1, abs=0.02) and row["v"] == pytest.approx(1, abs=0.03)


def test_kendall_carries_over_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, 400), rng.integers(0, 25, 400)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x int, y int")
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    expected = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
    for piece in (7, 65_536):
        monkeypatch.setattr(rankstats, "PIECE", piece)
        assert rankstats.kendall_tau(df, [], "x", "y", "id").first()["value"] == pytest.approx(expected, abs=1e-12)
