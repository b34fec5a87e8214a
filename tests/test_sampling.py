"""Laws of the sampling and sequence operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import sampling, sequences


def labelled(spark, labels):
    return spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "id int, y int")


@pytest.mark.parametrize("labels, n", [([1] * 5, 3), ([0, 0, 1, 1, 2, 2, 3, 3], 2), ([0, 1, 2], 10), ([], 5), ([0, 1, 1], 0)])
def test_balanced_sample_size(spark, labels, n):
    out = [r["id"] for r in sampling.balanced_sample(labelled(spark, labels), "y", n, 1, "id").collect()]
    assert len(out) == len(set(out)) == min(n, len(labels))


@pytest.mark.parametrize("seed", range(3))
def test_balanced_sample_covers_classes_and_is_even(spark, seed):
    rng = np.random.default_rng(seed)
    labels = np.minimum(rng.geometric(0.15, 2000), 20) - 1
    k, n = len(np.unique(labels)), 240
    drawn = sampling.balanced_sample(labelled(spark, labels), "y", n, seed, "id").groupBy("y").count().collect()
    counts = {r["y"]: r["count"] for r in drawn}
    assert len(counts) == k and sum(counts.values()) == n
    have = np.bincount(labels)
    for y, c in counts.items():
        assert c >= min(have[y], n // k)
    plain = sampling.sample_n(labelled(spark, labels), n, seed, "id").groupBy("y").count().collect()
    assert np.std(list(counts.values())) < np.std([r["count"] for r in plain] + [0] * (k - len(plain)))


def test_cut_keeps_the_lowest_hashes(spark):
    labels = [0] * 20_000 + [1] * 300 + [2] * 40
    df = labelled(spark, labels)
    cut = {r["id"] for r in sampling.balanced_sample(df, "y", 900, 4, "id").collect()}
    ranked = sampling._shuffled(df, 4, "id", "row").select("id", "y", "_h").toPandas().sort_values(["_h", "id"])
    want = set(ranked.groupby("y").head(300)["id"])
    rest = ranked[~ranked["id"].isin(want)]
    assert cut == want | set(rest["id"].head(900 - len(want))) and len(cut) == 900
    simple = {r["id"] for r in sampling.sample_n(df, 500, 4, "id").collect()}
    order = sampling._shuffled(df, 4, "id", "simple").select("id", "_h").toPandas().sort_values(["_h", "id"])
    assert simple == set(order["id"].head(500))


def test_same_seed_same_rows(spark):
    df = labelled(spark, range(500))
    first = {r["id"] for r in sampling.sample_n(df, 50, 9, "id").collect()}
    again = {r["id"] for r in sampling.sample_n(df.repartition(7), 50, 9, "id").collect()}
    other = {r["id"] for r in sampling.sample_n(df, 50, 10, "id").collect()}
    assert first == again != other


def test_stratified_sample(spark):
    rows = [(i, f"t{i % 2}", int(i % 5 == 0), "train" if i % 4 else "test") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, task string, label int, split string")
    assert sampling.stratified_sample(df, -1, 1, "id").count() == 400
    out = sampling.stratified_sample(df, 11, 1, "id")
    got = {(r["task"], r["label"], r["split"]): r["count"] for r in out.groupBy("task", "label", "split").count().collect()}
    assert {v for k, v in got.items() if k[1] == 0 and k[2] == "train"} == {5}
    assert {v for k, v in got.items() if k[1] == 1 and k[2] == "train"} == {6}
    assert sum(v for k, v in got.items() if k[2] == "test") == 100
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 1, 1, "id")


def test_temporal_split_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b", f"2020-01-{i + 1:02d}") for i in range(8)], "id int, k string, d string")
    out = sampling.temporal_split(df, ["k"], ["d", "id"])
    train = {r["id"] for r in out.where("split = 'train'").collect()}
    assert train == {0, 1, 2, 3, 4}


def video(spark, lengths):
    rows = [(v, i, i) for v, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "video int, frame int, event int")


@pytest.mark.parametrize("n, stride", [(16, 1), (31, 2), (76, 5), (90, 5)])
def test_clip_stride_shrinks_to_fit(spark, n, stride):
    out = sequences.sample_clip(video(spark, {1: n, 2: 15}), "video", ["frame"], 16, 5, 3).collect()
    assert len(out) == 16 and {r["video"] for r in out} == {1}
    picked = sorted(r["frame"] for r in out)
    assert {b - a for a, b in zip(picked, picked[1:])} == {stride} and picked[-1] < n


def test_uniform_sampling(spark):
    out = sequences.sample_uniform(video(spark, {1: 100, 2: 10}), "video", ["frame"], 32)
    got = {v: sorted(r["frame"] for r in out.where(F.col("video") == v).collect()) for v in (1, 2)}
    assert got[1] == list(range(0, 96, 3)) and got[2] == list(range(10))


def test_gaps_and_short_videos(spark):
    rows = [(1, 1, 1), (1, 2, 2), (1, 4, 3), (2, 1, 4)]
    df = spark.createDataFrame(rows, "video int, frame int, arrived int")
    assert [tuple(r) for r in sequences.check_gaps(df, "video", "frame", ["arrived"]).collect()] == [(1, 4, 3)]
    assert sequences.complete_sequences(df, ["video"], 2).select("video").distinct().count() == 1


def test_label_mode_prefers_lowest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (1, 3), (2, 9)], "v int, y int")
    assert sorted(map(tuple, sequences.label_mode(df, ["v"], "y").collect())) == [(1, 3), (2, 9)]


def test_random_labels_cover_unknown(spark):
    train = spark.createDataFrame([(4,)] * 3 + [(9,)], "label int")
    test = spark.range(400).withColumn("y_true", F.lit(4))
    drawn = sampling.random_labels(test, train, 10, 1, "id").groupBy("y_pred").count().collect()
    counts = {r["y_pred"]: r["count"] / 4000 for r in drawn}
    assert set(counts) == {-1, 4, 9}
    assert counts[4] == pytest.approx(0.6, abs=0.04) and counts[-1] == pytest.approx(0.2, abs=0.04)
    even = sampling.random_labels(test, train, 10, 1, "id", uniform=True).groupBy("y_pred").count().collect()
    assert all(r["count"] / 4000 == pytest.approx(1 / 3, abs=0.04) for r in even)


def test_chance_multilabel_over_several_blocks_of_trials(spark):
    """Trials are drawn in blocks; each equals the metric of the plain coins, also with a null trait."""
    from evalspark.operators import metrics

    rows = [(i, [i % 2, None if i == 3 else int(i % 3 == 0)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, y_true array<int>")
    fast = {r["trial"]: r["value"] for r in sampling.chance_multilabel(df, 2, 70, 5, "id").collect()}
    plain = metrics.multilabel_macro_f1(sampling.random_bits(df, 2, 70, 5, "id"), ["trial"])
    want = {r["trial"]: r["value"] for r in plain.collect()}
    assert fast.keys() == want.keys() and all(abs(fast[t] - want[t]) < 1e-12 for t in want)
