"""Metric laws, known values and the weighted form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import costs, metrics

BY = ["task_name", "model_ckpt"]


def frame(spark, y_true, y_pred, model="m"):
    rows = [("t", model, str(i), float(t == p), int(t), int(p)) for i, (t, p) in enumerate(zip(y_true, y_pred))]
    return spark.createDataFrame(rows, "task_name string, model_ckpt string, img_id string, score double, y_true int, y_pred int")


def value(df):
    return df.first()["value"]


def dense_macro_f1(t, p, n_classes=None):
    n_classes = max(t.max(), p.max()) + 1 if n_classes is None else n_classes
    total = 0.0
    for c in range(n_classes):
        both = (t == c).sum() + (p == c).sum()
        total += 2 * ((t == c) & (p == c)).sum() / both if both else 0.0
    return total / n_classes


@pytest.mark.parametrize("seed", range(4))
def test_random_labels_match_direct_formulas(spark, seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 300)), int(rng.integers(1, 50))
    t, p = rng.integers(0, k, n), rng.integers(0, k, n)
    df = frame(spark, t, p).cache()
    acc = (t == p).mean()
    assert value(metrics.micro_acc(df, BY)) == pytest.approx(acc, abs=1e-12)
    assert value(metrics.micro_f1(df, BY)) == pytest.approx(acc, abs=1e-12)
    assert value(metrics.mean_score(df, BY)) == pytest.approx(acc, abs=1e-12)
    recalls = [(p[t == c] == c).mean() for c in np.unique(t)]
    assert value(metrics.macro_acc(df, BY)) == pytest.approx(np.mean(recalls), abs=1e-12)
    assert value(metrics.macro_f1(df, BY)) == pytest.approx(dense_macro_f1(t, p), abs=1e-12)
    assert value(metrics.macro_f1(df, BY, n_classes=60)) == pytest.approx(dense_macro_f1(t, p, 60), abs=1e-12)
    row = metrics.summary(df, BY).first()
    assert row["micro_acc"] == pytest.approx(acc) and row["macro_acc"] == pytest.approx(np.mean(recalls))
    assert row["macro_f1"] == pytest.approx(dense_macro_f1(t, p), abs=1e-12)
    present = len(np.union1d(t, p))
    expected = dense_macro_f1(t, p) * (max(t.max(), p.max()) + 1) / present
    assert value(metrics.macro_f1(df, BY, present_only=True)) == pytest.approx(expected, abs=1e-12)


def test_absent_lower_classes_count_as_zero(spark):
    assert value(metrics.macro_f1(frame(spark, [2], [2]), BY)) == pytest.approx(1 / 3)


def test_weight_equals_repetition(spark):
    rng = np.random.default_rng(5)
    t, p, w = rng.integers(0, 6, 80), rng.integers(0, 6, 80), rng.integers(0, 4, 80)
    weighted = frame(spark, t, p).join(spark.createDataFrame([(str(i), int(x)) for i, x in enumerate(w)], "img_id string, w int"), "img_id")
    repeated = frame(spark, np.repeat(t, w), np.repeat(p, w))
    for fn in (metrics.micro_acc, metrics.macro_acc, metrics.micro_f1, metrics.mean_score):
        assert value(fn(weighted, BY, "w")) == pytest.approx(value(fn(repeated, BY)), abs=1e-12)
    assert value(metrics.macro_f1(weighted, BY, "w", n_classes=6)) == pytest.approx(
        value(metrics.macro_f1(repeated, BY, n_classes=6)), abs=1e-12
    )


def test_multilabel_is_mean_over_traits(spark):
    rng = np.random.default_rng(1)
    t, p = rng.integers(0, 2, (40, 9)), rng.integers(0, 2, (40, 9))
    rows = [("t", "m", str(i), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, p))]
    df = spark.createDataFrame(rows, "task_name string, model_ckpt string, img_id string, y_true array<int>, y_pred array<int>")
    expected = np.mean([dense_macro_f1(t[:, j], p[:, j], 2) for j in range(9)])
    assert value(metrics.multilabel_macro_f1(df, BY)) == pytest.approx(expected, abs=1e-12)


def test_group_sizes_are_checked(spark):
    df = frame(spark, [0, 1], [0, 1]).unionByName(frame(spark, [0], [0], "other"))
    assert metrics.check_equal_n(df, ["model_ckpt"]).first()["consistent"] is False
    with pytest.raises(ValueError):
        metrics.assert_equal_n(df, ["model_ckpt"])


@pytest.mark.parametrize(
    "fn, t, p, expected",
    [
        (costs.unknown_error, [0, 1, 2, 3], [0, 1, 2, 3], 0.0),
        (costs.class_error, [0, 1, 2, 3], [4, 5, 6, 7], 1.0),
        (costs.unknown_error, [-1, 10], [5, -1], 5.05),
        (costs.class_error, [-1, 10], [5, -1], 1.0),
    ],
)
def test_error_costs(spark, fn, t, p, expected):
    assert value(fn(frame(spark, t, p), BY)) == pytest.approx(expected)


def test_harm_counts_and_costs(spark):
    df = frame(spark, [1, 2, 3, 4], [2, 3, 4, 1])
    row = costs.psc_esc(df, BY, [1, 3]).first()
    assert (row["psc"], row["esc"]) == (2, 2)
    assert value(costs.psc_esc_cost(df, BY, [1, 3])) == pytest.approx(50.5)
    table = spark.createDataFrame([(1,), (3,), (3,)], "class_id int")
    assert value(costs.psc_esc_cost(df, BY, table)) == pytest.approx(50.5)


def test_perfect_cost_report(spark):
    row = costs.cost_report(frame(spark, [0, 1, 2, 3], [0, 1, 2, 3]), BY, [1, 3]).first()
    assert row["f1_macro"] == pytest.approx(100.0)
    assert [row[c] for c in ("ce", "psc_esc_cost", "user_loss", "ce_unk")] == [0.0] * 4


@pytest.mark.parametrize("seed", range(3))
def test_normalised_loss_is_a_share(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 100))
    df = frame(spark, rng.integers(-1, 51, n), rng.integers(-1, 51, n))
    assert 0.0 <= value(costs.user_loss_norm(df, BY, [1, 3])) <= 1.0
    assert value(costs.user_loss_norm(df.withColumn("y_pred", F.col("y_true")), BY, [1, 3])) == pytest.approx(1.0)
