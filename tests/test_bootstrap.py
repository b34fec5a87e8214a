"""Resampling laws and the significance tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import bootstrap as boot
from evalspark.operators import longtail, rankstats
from evalspark.plans import report

SCHEMA = "task_name string, model_ckpt string, img_id string, score double, y_true int, y_pred int"


def predictions(spark, n=300, models=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(models):
        for i in range(n):
            t = i % 5
            p = t if rng.random() < 0.4 + 0.2 * m else int(rng.integers(0, 5))
            rows.append(("t", f"m{m}", str(i), float(t == p), t, p))
    return spark.createDataFrame(rows, SCHEMA)


def test_multinomial_draws_n_of_n_for_every_model(spark):
    rows = boot.replicate_rows(predictions(spark), 8, 1)
    sizes = rows.groupBy("model_ckpt", "replicate").agg(F.sum("w").alias("n")).collect()
    assert len(sizes) == 24 and {r["n"] for r in sizes} == {300}


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_draws_are_paired_and_intervals_cover(spark, method):
    df = predictions(spark)
    rows = boot.replicate_rows(df, 4, 1, method)
    per_example = rows.groupBy("img_id", "replicate").agg(F.count_distinct("w").alias("k")).agg(F.max("k")).first()[0]
    assert per_example == 1
    point = {r["model_ckpt"]: r["value"] for r in report.metrics.mean_score(df, ["model_ckpt"]).collect()}
    ci = boot.summarize_ci(boot.bootstrap_mean(df, 200, 3, method), 0.05).collect()
    for r in ci:
        spread = np.sqrt(point[r["model_ckpt"]] * (1 - point[r["model_ckpt"]]) / 300)
        assert r["ci_low"] < point[r["model_ckpt"]] < r["ci_high"]
        assert r["ci_high"] - r["ci_low"] == pytest.approx(3.92 * spread, rel=0.3)


@pytest.mark.parametrize("cells", [10, 4_000_000])
@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_summed_counts_equal_repeated_rows(spark, monkeypatch, method, cells):
    monkeypatch.setattr(boot, "BATCH_CELLS", cells)
    df = predictions(spark, 60, 2)
    keys = ["model_ckpt", "replicate", "y_true", "y_pred"]

    def table(rows):
        return sorted(map(tuple, rows.groupBy(*keys).agg(F.sum("w").alias("w")).where("w > 0").select(*keys, "w").collect()))

    summed = table(boot.replicate_cells(df, ["y_true", "y_pred"], 7, 1, method))
    assert summed == table(boot.replicate_rows(df, 7, 1, method)) and summed


def test_unknown_method_is_rejected(spark):
    with pytest.raises(ValueError):
        boot.replicate_rows(predictions(spark, 3), 2, 1, "other")
    with pytest.raises(ValueError):
        boot.replicate_cells(predictions(spark, 3), ["score"], 2, 1, "other")


def test_holm_known_values(spark):
    df = spark.createDataFrame([("t", f"m{i}", p) for i, p in enumerate((0.02, 1.0, 0.001, 0.03))], "task_name string, model_ckpt string, p double")
    out = {r["p"]: (round(r["p_adj"], 9), r["reject"]) for r in boot.holm(df, ["task_name"], 0.05).collect()}
    assert out == {0.001: (0.004, True), 0.02: (0.06, False), 0.03: (0.06, False), 1.0: (1.0, False)}


def test_best_and_ties(spark):
    rows = [("t", "a", r, 0.9) for r in range(50)] + [("t", "b", r, 0.9) for r in range(50)] + [("t", "c", r, 0.1) for r in range(50)]
    out = boot.best_and_ties(spark.createDataFrame(rows, "task_name string, model_ckpt string, replicate int, value double"), 0.05).first()
    assert (out["best"], out["ties"]) == ("a", ["a", "b"])


def test_report_covers_every_kind_of_score(spark):
    base = predictions(spark, 120).withColumns({c: F.col(c).cast("string") for c in ("y_true", "y_pred")})
    multi = base.withColumns({c: F.concat(F.lit("["), F.when(F.col(c).cast("int") > 2, "1").otherwise("0"), F.lit(", 1]")) for c in ("y_true", "y_pred")})
    names = {"newt": base, "imagenet1k": base, "beluga": base, "fungiclef": base, "fishnet": multi, "other": base}
    parts = [df.withColumn("task_name", F.lit(name)) for name, df in names.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    scores, bests = report.calc_scores(rows, b=30, seed=2, harmful=[1, 3])
    got = scores.collect()
    assert {r["task"] for r in got} == set(names) - {"other"} and len(got) == 15
    assert all(r["ci_low"] <= r["bootstrap_mean"] <= r["ci_high"] for r in got)
    assert all(abs(r["mean"] - r["bootstrap_mean"]) < 0.1 for r in got)
    assert all(r["best"] in r["ties"] for r in bests.collect())


def test_rank_statistics(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(30)], "id int, x double, y double")
    for stat in rankstats.STATISTICS.values():
        assert stat(df, [], "x", "y", "id").first()["value"] == pytest.approx(1.0)
        assert stat(df.withColumn("y", -F.col("y")), [], "x", "y", "id").first()["value"] == pytest.approx(-1.0)
    flat = df.withColumn("y", F.lit(1.0))
    assert rankstats.pearson(flat, [], "x", "y").first()["value"] == 0.0
    assert rankstats.kendall_tau(flat, [], "x", "y", "id").first()["value"] is None
    assert rankstats.permutation_p(df, "x", "y", "id", 19, 1).first()["p"] == pytest.approx(1 / 20)


@pytest.mark.parametrize("counts", [[5, 1, 1, 3, 9], [4, 4, 4], list(range(1, 60)), [1] * 9 + [91]])
def test_long_tail_formulas(spark, counts):
    df = spark.createDataFrame([(c,) for c in counts], "n bigint")
    f = np.sort(np.array(counts, dtype=float))
    cum, desc = f.cumsum(), f[::-1]
    slope = np.polyfit(np.log(np.arange(1, len(f) + 1)), np.log(desc), 1)[0] if len(set(counts)) > 1 else 0.0
    share = f / f.sum()
    expected = {
        longtail.zipf_exponent: -slope,
        longtail.effective_classes: np.exp(-(share * np.log(share)).sum()),
        longtail.imbalance_ratio: f.max() / f.min(),
        longtail.gini: 1 - 2 * (cum / cum[-1]).sum() / (len(f) + 1),
        longtail.tail_mass: ((desc.cumsum() >= 0.9 * f.sum()).argmax() + 1) / len(f),
    }
    for fn, want in expected.items():
        assert fn(df, []).first()["value"] == pytest.approx(want, abs=1e-9), fn.__name__


def test_poisson_keeps_every_replicate(spark):
    rows = [("t", "m", str(i), 1.0, 1, 1) for i in range(2)]
    df = spark.createDataFrame(rows, "task_name string, model_ckpt string, img_id string, score double, y_true int, y_pred int")
    for found in (boot.bootstrap_mean(df, 40, 3, "poisson"), boot.bootstrap_macro_f1(df, 40, 3, "poisson")):
        values = {r[boot.REPLICATE]: r["value"] for r in found.collect()}
        assert sorted(values) == list(range(40))
        assert None in values.values()


def test_unequal_counts_are_an_error(spark):
    from evalspark.plans import report

    rows = [("newt", m, str(i), 1.0, "1", "1") for m, n in (("a", 3), ("b", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "task_name string, model_ckpt string, img_id string, score double, y_true string, y_pred string")
    with pytest.raises(ValueError, match="between 2 and 3"):
        report.calc_scores(df, b=3)
    assert report.calc_scores(df, b=3, equal_n=False)[0].count() == 2


def test_registered_replicates(spark):
    """Registered bootstraps draw as often as the reference."""
    from evalspark.catalog import all_queries

    for name, most in (("bootstrap_macro_f1", 500), ("bootstrap_mean_poisson", 500), ("bootstrap_multilabel", 500), ("bootstrap_spearman", 5000)):
        found = all_queries()[name](spark, "/root/testdata/sf0.001").agg(F.count_distinct("replicate").alias("n")).first()
        assert found["n"] == most


def test_hash_grid_equals_the_column(spark):
    from evalspark.functions.draws import hash_grid, hash_long

    prefixes, values = ["17-t-0", "17-t-10", "5-" + "ü" * 20], ["", "1", "22", "x" * 60, "é", *map(str, range(95, 105))]
    grid = hash_grid(prefixes, values)
    rows = [(p, v, i, j) for i, p in enumerate(prefixes) for j, v in enumerate(values)]
    df = spark.createDataFrame(rows, "p string, v string, i int, j int").withColumn("h", hash_long(F.col("p"), F.col("v")))
    assert all(r["h"] == grid[r["i"], r["j"]] for r in df.collect())
    numbers = np.array([0, 9, 10, 99, 100, 12345, 10**15])
    assert (hash_grid(prefixes, numbers) == hash_grid(prefixes, [str(n) for n in numbers])).all()
    assert hash_grid([], values).shape == (0, len(values)) and hash_grid(prefixes, []).shape == (3, 0)


def test_count_arrays_equal_repeated_rows(spark, monkeypatch):
    """Every statistic from count arrays against the metric of repeated rows, in small and large steps."""
    from evalspark.operators import costs, counts, metrics

    df = predictions(spark, 70, 2).withColumn("y_true", F.when(F.col("img_id") == "3", None).otherwise(F.col("y_true")))
    arrays = df.withColumns({c: F.array((F.col(c) > 2).cast("int"), F.when(F.col(c) > 0, 1)) for c in ("y_true", "y_pred")})
    arrays = arrays.withColumn("y_true", F.when(F.col("img_id") != "5", F.col("y_true")))
    by = [boot.TASK, boot.MODEL, boot.REPLICATE]

    def table(found):
        return {tuple(r)[:3]: r["value"] for r in found.collect()}

    pairs = [
        (boot.bootstrap_mean, metrics.mean_score, df, {}),
        (boot.bootstrap_accuracy, metrics.micro_acc, df, {}),
        (boot.bootstrap_multilabel, metrics.multilabel_macro_f1, arrays, {}),
        (lambda d, b, s, m: boot.bootstrap_user_loss(d, [1, 3], b, s, m), costs.user_loss_norm, df, {"harmful": [1, 3], "shared": by[:2]}),
    ]
    for method in ("multinomial", "poisson"):
        for cells, sums in ((2_000_000, 2**26), (40, 1)):
            monkeypatch.setattr(counts, "CELLS", cells)
            monkeypatch.setattr(counts, "SUM_BYTES", sums)
            for fast, plain, rows, options in pairs:
                got = table(fast(rows, 6, 1, method))
                want = table(boot.bootstrap(rows, plain, 6, 1, method, **options).select(*by, "value"))
                assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got), (method, plain)


def test_draws_beyond_one_run(spark, monkeypatch):
    """Positions of one task spread over several runs; the draws are those of one."""
    from evalspark.operators import counts

    df = predictions(spark, 100, 2)
    whole = sorted(map(tuple, boot.bootstrap_macro_f1(df, 9, 4).collect()))
    monkeypatch.setattr(counts, "RUN_BITS", 4)
    monkeypatch.setattr(counts, "RUN", 16)
    monkeypatch.setattr(counts, "SLOTS", 30)
    monkeypatch.setattr(counts, "PACK", 70)
    cut = sorted(map(tuple, boot.bootstrap_macro_f1(df, 9, 4).collect()))
    assert [r[:3] for r in cut] == [r[:3] for r in whole]
    assert np.allclose([r[3] for r in cut], [r[3] for r in whole])


def test_pair_counts_on_both_paths(spark, limits):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.integers(0, 9)), float(rng.integers(0, 7))) for g in ("a", "b", None) for i in range(60)]
    rows += [("a", 100, None, 1.0), ("b", 101, 1.0, None), ("c", 1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    fast = {r["g"]: r["value"] for r in rankstats.kendall_tau(df, ["g"], "x", "y", "id").collect()}

    def tau(points):
        signs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for i, a in enumerate(points) for b in points[:i]]
        up, down = sum(s * t > 0 for s, t in signs), sum(s * t < 0 for s, t in signs)
        free = [sum(s[k] != 0 for s in signs) for k in (0, 1)]
        return (up - down) / np.sqrt(free[0] * free[1]) if min(free) else None

    for g in ("a", "b", None, "c"):
        want = tau([(r[2], r[3]) for r in rows if r[0] == g and r[2] is not None and r[3] is not None])
        assert fast[g] == (None if want is None else pytest.approx(want))
    limits("groupRows", 5)
    slow = {r["g"]: r["value"] for r in rankstats.kendall_tau(df.where("g IS NOT NULL"), ["g"], "x", "y", "id").collect()}
    assert all(slow[g] == pytest.approx(fast[g]) for g in ("a", "b"))


def test_hash_range_equals_the_grid():
    from evalspark.functions.draws import hash_grid, hash_range

    for prefix in ("17-F-3", "1-" + "x" * 45, "z" * 60, "ü-1"):
        for first, stop in ((0, 0), (0, 12), (95, 1205), (9_990, 30_020), (99_990, 100_020), (9_999_990, 10_000_012)):
            assert (hash_range(prefix, first, stop) == hash_grid([prefix], [str(n) for n in range(first, stop)])[0]).all()


@pytest.mark.parametrize("statistic", ["tau", "rho"])
def test_rank_replicates_make_no_rows(spark, limits, statistic):
    """Replicates of groups that fit a task: the values of the drawn rows, none of which leaves the task."""
    rng = np.random.default_rng(5)
    rows = [(g, f"i{i}", float(rng.integers(0, 9)), None if i == 7 else float(rng.integers(0, 7))) for g in (0.25, 1.0) for i in range(70)]
    rows += [(2.0, "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g double, id string, x double, y double")

    def table():
        found = rankstats.bootstrap_rank(df, ["g"], "x", "y", "id", 6, 3, statistic)
        return found, {(r["g"], r["replicate"]): r["value"] for r in found.collect()}

    found, fast = table()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(fast) == 18
    p_fast = rankstats.permutation_p(df.where("g = 1"), "x", "y", "id", 50, 2, statistic).first()["p"]
    limits("groupRows", 5)
    _, slow = table()
    for key in fast:
        assert fast[key] == slow.get(key) if slow.get(key) is None else fast[key] == pytest.approx(slow[key], abs=1e-12)
    assert p_fast == rankstats.permutation_p(df.where("g = 1"), "x", "y", "id", 50, 2, statistic).first()["p"]


def test_draws_travel_as_counts(spark, monkeypatch):
    """A draw takes far less than the four bytes of a number, also where a replicate is drawn in pieces."""
    from evalspark.functions.draws import hash_range
    from evalspark.operators import counts

    n, b = 20_000, 6

    def table():
        found, size = np.zeros((b, n + counts.RUN), int), 0
        for r in counts.packed_draws(spark, {"t": n}, b, 9).collect():
            size += len(r["_draws"])
            found[r["replicate"], r["_run"] * counts.RUN :][: counts.RUN] += counts._unpack([np.frombuffer(r["_draws"], np.uint8)])[0]
        return found[:, :n], size

    whole, size = table()
    want = np.stack([np.bincount(hash_range(f"9-t-{r}", 0, n) % n, minlength=n) for r in range(b)])
    assert (whole == want).all() and size < n * b / 2
    monkeypatch.setattr(counts, "SLOTS", 7_000)
    assert (table()[0] == want).all()


def test_profiles_are_few():
    """Examples with equal rows are added up once, whatever the order of their models."""
    import pyarrow as pa

    from evalspark.operators import counts

    rows = [{"model_ckpt": m, "score": 1.0} for m in ("a", "b")]
    part = pa.RecordBatch.from_pylist([{"task_name": "t", "_rows": rows[:: 1 - 2 * (i % 2)]} for i in range(10)])
    sums = counts._Sums(counts.weighted_mean("score"), 3)
    sums.add(part, np.ones((10, 3), np.uint8))
    sums.add(part, np.ones((10, 3), np.uint8))
    assert len(sums.at) == 1
    sent = pa.Table.from_batches(list(sums.take())).to_pylist()
    assert [(r["model_ckpt"], r["_sums"]) for r in sent] == [(m, [20.0] * 6) for m in ("a", "b")] and not sums.at


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_examples_told_in_numbers(spark, monkeypatch, method):
    """Rows of few kinds make no lists; lists give the same replicates, and repeated or many rows take them."""
    from evalspark.operators import counts

    df = predictions(spark, 90, 3).withColumn("y_pred", F.when(F.col("img_id") == "4", None).otherwise(F.col("y_pred")))
    df = df.withColumn("score", F.when(F.col("img_id") == "7", float("nan")).when(F.col("img_id") == "8", -0.0).otherwise(F.col("score")))
    listed, used = counts._listed_examples, []
    monkeypatch.setattr(counts, "_listed_examples", lambda *a: used.append(1) or listed(*a))
    metrics = [boot.bootstrap_accuracy, boot.bootstrap_mean, boot.bootstrap_macro_f1, lambda d, *a: boot.bootstrap_user_loss(d, [1, 3], *a)]

    def table(metric, rows):
        return [(*r[:3], None if r[3] is None else repr(round(r[3], 9))) for r in sorted(metric(rows, 7, 2, method).collect(), key=lambda r: r[:3])]

    got = [table(m, df) for m in metrics]
    assert not used
    monkeypatch.setattr(counts, "KINDS", 1)
    assert [table(m, df) for m in metrics] == got and len(used) == len(metrics)
    monkeypatch.undo()
    monkeypatch.setattr(counts, "_listed_examples", lambda *a: used.append(1) or listed(*a))
    used.clear()
    twice = df.union(df.where("img_id = '5'"))
    values = table(boot.bootstrap_accuracy, twice)
    assert len(used) == 1 and values != got[0] and [v[:3] for v in values] == [v[:3] for v in got[0]]


def test_fields_of_words():
    """A field for each model; what does not fit is left to lists."""
    from evalspark.operators import counts

    found = [(m, v) for m in ("a", None, "c") for v in range(2**21 - 1)]
    layout = counts._layout(found[: 2**21 + 5], [])
    assert layout.words == 1 and layout.rows("t", (3 << 21 | 7,)) == [("t", "a", 6), ("t", None, 2)]
    layout = counts._layout(found, [])
    assert [f[1:] for f in layout.fields] == [(0, 0, 21), (0, 21, 21), (1, 0, 21)]
    assert layout.rows(None, (0, 1)) == [(None, "c", 0)]
    assert counts._layout([(m, 0) for m in range(63)], []) is None


def test_draws_without_the_package(tmp_path):
    """What tasks run travels with them: it works where the package can't be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from evalspark.functions.draws import hash_range
    from evalspark.operators import counts

    for name, function in (("range", hash_range), ("counts", counts._drawn_windows)):
        (tmp_path / name).write_bytes(cloudpickle.dumps(function))
    code = """
import pickle, sys
assert not any("repo" in p for p in sys.path), sys.path
draw = pickle.load(open("range", "rb"))
print(draw("3-a", 99_990, 100_010).tolist() == draw("3-a", 99_990, 100_010).tolist(), draw("3-a", 5, 6)[0])
pickle.load(open("counts", "rb"))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=60)
    assert done.stdout.split() == ["True", str(hash_range("3-a", 5, 6)[0])], done.stderr
