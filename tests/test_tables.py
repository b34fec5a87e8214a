"""Labels, text functions, joins, sources and the results store."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.functions import labels, text
from evalspark.operators import tables
from evalspark.plans import backlog, leaderboard
from evalspark.scaling import shared_folder
from evalspark.sources import store
from evalspark.sources import tables as sources


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column, values, expected",
    [
        (lambda: text.fs_safe(F.col("s")), {"s": "hf-hub:a/b"}, "hf-hub_a_b"),
        (lambda: text.fs_safe(text.fs_safe(F.col("s"))), {"s": "a:b/c"}, "a_b_c"),
        (lambda: text.pretrain_ckpt(F.col("s")), {"s": "/x/net_vitb16_pretrain_lvd1689m-73cec8be.pth"}, "net_vitb16"),
        (lambda: text.base_name(F.col("s")), {"s": "a/b/c.JPG"}, "c.JPG"),
        (lambda: text.stem(F.col("s")), {"s": "a/b/c.tar.gz"}, "c.tar"),
        (lambda: text.percent_label(F.col("x")), {"x": 0.8766}, "87.7"),
        (lambda: text.big_int_label(F.col("n")), {"n": 999}, "999"),
        (lambda: text.big_int_label(F.col("n")), {"n": 304_000_000}, "304M"),
        (lambda: text.range_label(F.lit(0), F.col("n")), {"n": 50_000_000}, "<50M"),
        (lambda: text.range_label(F.col("n"), F.lit(text.UPPER_LIMIT)), {"n": 2_000_000_000}, "2B+"),
        (lambda: text.month_year(F.col("n")), {"n": 1_681_776_000_000}, "April 2023"),
        (lambda: text.plain_text(F.col("s")), {"s": "“a” → b…"}, '"a" -> b...'),
        (lambda: text.first_non_ascii(F.col("s")), {"s": "abé"}, 3),
        (lambda: labels.cast_label(F.col("s")), {"s": "3.0"}, 3),
        (lambda: F.to_json(text.json_labels(F.col("s"))), {"s": "[true, false]"}, "[1,0]"),
        (lambda: text.frame_count_vote(F.array(F.lit(100), F.lit(100), F.lit(300))), {"s": ""}, 100),
        (lambda: text.frame_count_vote(F.array(F.lit(500), F.lit(503), F.lit(9))), {"s": ""}, 500),
        (lambda: text.frame_count_vote(F.array(F.lit(100), F.lit(300))), {"s": ""}, None),
        (lambda: text.frame_count_vote(F.array(F.lit(None).cast("int"), F.lit(7))), {"s": ""}, 7),
    ],
)
def test_scalar_functions(spark, column, values, expected):
    assert one(spark, column(), **values) == expected


def test_json_keys_and_strict_encoding(spark):
    rows = ['{"y_true": 3, "y_pred": 4}', '{"true_y": 5, "pred_y": "6"}', '{"y_true": [1, 0], "y_pred": [true]}', "{}"]
    df = labels.parse_info(spark.createDataFrame([(r,) for r in rows], "info string"))
    got = [(r["y_true"], r["y_pred"]) for r in df.collect()]
    assert got[:2] == [("3", "4"), ("5", "6")] and got[3] == (None, None)
    assert (json.loads(got[2][0]), json.loads(got[2][1])) == ([1, 0], [True])
    habitat = spark.createDataFrame([("pelagic",), ("benthic",), ("reef",)], "h string")
    lenient = habitat.select(labels.encode_binary(F.col("h"), "pelagic", "benthic", strict=False).alias("v"))
    assert [r["v"] for r in lenient.collect()] == [1, 0, 1]
    with pytest.raises(PySparkException):
        habitat.select(labels.encode_binary(F.col("h"), "pelagic", "benthic")).collect()


def test_stale_limit_is_strict(spark):
    now = 1_700_000_000
    ages = [5, 71.99, 72, 72.01, 150]
    claims = spark.createDataFrame([(a, now - a * 3600.0) for a in map(float, ages)], "age double, posix double")
    assert {r["age"] for r in tables.stale_rows(claims, now).collect()} == {72.01, 150.0}
    assert {r["age"] for r in tables.fresh_rows(claims, now).collect()} == {5.0, 71.99, 72.0}
    with pytest.raises(ValueError):
        tables.stale_rows(claims, now, 0)


def test_missing_file_fails(spark):
    names = spark.createDataFrame([("A.JPG",), ("b.jpg",)], "name string")
    files = spark.createDataFrame([("a.jpg",)], "file string")
    assert tables.resolve_path(names.limit(1), files).first()["path"] == "a.jpg"
    assert tables.resolve_path(names, files, strict=False).where("path is null").count() == 1
    with pytest.raises(PySparkException):
        tables.resolve_path(names, files).collect()


def test_grid_and_backlog(spark):
    models = spark.createDataFrame([("o", "a"), ("o", "b")], "model_org string, model_ckpt string")
    grid = tables.expand_grid(models, {"debug": [True, False], "n_train": [-1, 10]}, data={"newt": "/n"})
    assert grid.count() == 8 and {r["data"]["newt"] for r in grid.collect()} == {"/n"}
    kinds = spark.createDataFrame([("NeWT", "/d", True), ("x", None, True), ("y", "/d", False)], "task_name string, data_root string, has_code boolean")
    runs = [("newt", "o", "a", -1)]
    done = spark.createDataFrame(runs, "task_name string, model_org string, model_ckpt string, n_train int")
    claims = spark.createDataFrame([("NEWT", "o", "b", -1)], done.schema)
    wanted = backlog.wanted_runs(models.withColumn("n_train", F.lit(-1)), kinds)
    got = {(r["task_name"], r["model_ckpt"]): r["reason"] for r in backlog.backlog(wanted, done, claims).collect()}
    assert got == {("newt", "a"): "done", ("newt", "b"): "queued", ("x", "a"): "no data", ("x", "b"): "no data", ("y", "a"): "no code", ("y", "b"): "no code"}


def test_open_ranges(spark):
    df = spark.createDataFrame([("f", 224, p) for p in (49_999_999, 50_000_000, 50_000_001)], "family string, resolution int, params bigint")
    kept = leaderboard.filter_models(df, ["f"], [224], [(0, 50_000_000), (50_000_000, 100_000_000)])
    assert {r["params"] for r in kept.collect()} == {49_999_999, 50_000_001}


def test_sort_is_reversible(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 1.0)], "model string, v double")
    up = [r["model"] for r in leaderboard.sort_leaderboard(df, "v", descending=False).collect()]
    down = [r["model"] for r in leaderboard.sort_leaderboard(df, "v").collect()]
    assert up == ["b", "a", "d", "c"] and down == up[::-1]


def test_coco_needs_one_annotation(spark):
    path = shared_folder(spark, "coco-test")
    doc = {"images": [{"id": 1, "file_name": "a"}, {"id": 2, "file_name": "b"}], "annotations": [{"id": 9, "image_id": 1, "name": "whale"}]}
    spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").coalesce(1).write.text(path)
    rows = {r["img_id"]: r["label"] for r in sources.read_coco(spark, path, strict=False).collect()}
    assert rows == {"1": "whale", "2": None}
    with pytest.raises(PySparkException):
        sources.read_coco(spark, path).collect()


def test_keyed_json_document(spark):
    path = shared_folder(spark, "keyed-test")
    doc = {"v1": {"annotations": [{"label": "eat", "segment": [1.5, 3]}], "taxnomy": [{"class": "x"}], "duration": 10, "resolution": "640x480", "fps": 30, "subset": "train", "url": "u"}, "v2": {"annotations": []}}
    spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").coalesce(1).write.text(path)
    rows = {r["vid_id"]: r for r in sources.read_videos(spark, path).collect()}
    assert rows["v1"]["annotations"][0].asDict() == {"label": "eat", "start_s": 1.5, "end_s": 3.0}
    assert tuple(rows["v1"]["resolution"]) == (640, 480) and rows["v2"]["annotations"] == []


def test_half_written_run_is_invisible(spark):
    folder = shared_folder(spark, "store-test")
    rows = spark.createDataFrame([("1", 1.0, "{}")], "img_id string, score double, info string")
    store.write_report(rows, store.RunInfo("NeWT", "o", "a", posix=1.0), folder)
    orphan = rows.withColumns({"experiment_id": F.lit(5).cast("bigint"), "task_name": F.lit("newt")})
    orphan.write.mode("append").partitionBy("task_name").parquet(f"{folder}/predictions")
    assert store.read_predictions(spark, folder).count() == 2
    seen = store.read_results(spark, folder).collect()
    assert [(r["task_name"], r["model_ckpt"]) for r in seen] == [("newt", "a")]
    pruned = store.read_predictions(spark, folder).where("task_name = 'newt'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(task_name" in pruned


def test_failed_attempt_and_retry(spark, monkeypatch):
    folder = shared_folder(spark, "store-test")
    rows = spark.createDataFrame([("1", 1.0, "{}"), ("2", 0.0, "{}")], "img_id string, score double, info string")
    info = store.RunInfo("NeWT", "o", "a")
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):

        def fail(self, *args, **kwargs):
            raise RuntimeError("lost before the experiments row")

        patch.setattr(type(spark), "createDataFrame", fail)
        store.write_report(rows, info, folder)
    store.write_report(rows, info, folder)
    assert store.read_results(spark, folder).count() == 2
    store.write_report(rows.where("img_id = '1'"), info, folder)
    assert [r["img_id"] for r in store.read_results(spark, folder).collect()] == ["1"]
    store.write_report(rows, store.RunInfo("NeWT", "o", "b"), folder)
    assert store.read_results(spark, folder).count() == 3


def test_audit_reports_every_kind(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, content string")
    manifest = files.where("name <> 'c'").select("name", F.md5("content").alias("md5")).withColumn("md5", F.when(F.col("name") == "b", "0").otherwise(F.upper("md5")))
    manifest = manifest.unionByName(spark.createDataFrame([("d", "0")], "name string, md5 string"))
    got = {r["name"]: r["status"] for r in tables.audit_md5(files, manifest).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unlisted", "d": "missing"}


def test_many_runs_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame(
        [("NeWT", m, str(i), 1.0, "{}") for m in ("a", "b") for i in range(3)],
        "task_name string, model_ckpt string, img_id string, score double, info string",
    )
    folder = str(tmp_path / "store")
    runs = [store.RunInfo("NeWT", "o", m) for m in ("a", "b")]
    store.write_reports(rows, runs, folder)
    store.write_reports(rows.where("img_id = '0'"), runs, folder)
    assert store.read_results(spark, folder).groupBy("task_name", "model_ckpt").count().orderBy("model_ckpt").collect() == [("newt", "a", 1), ("newt", "b", 1)]
    with pytest.raises(PySparkException, match="no run for newt b"):
        store.write_reports(rows, runs[:1], folder)
    with pytest.raises(ValueError, match="two runs"):
        store.write_reports(rows, runs + runs[:1], folder)


def test_one_prediction_per_example_and_run(spark, tmp_path):
    schema = "img_id string, score double, info string"
    rows = spark.createDataFrame([("1", 1.0, "{}"), ("2", 0.0, "{}"), ("1", 0.0, "{}")], schema)
    folder = str(tmp_path / "store")
    with pytest.raises(PySparkException, match="two predictions for newt 1"):
        store.write_report(rows, store.RunInfo("NeWT", "o", "a"), folder)
    store.write_report(rows.where("score = 0"), store.RunInfo("NeWT", "o", "a"), folder)
    assert store.read_results(spark, folder).count() == 2


def test_later_attempts_have_larger_ids(spark, tmp_path, monkeypatch):
    """Also when the writer's clock is behind."""
    ids = store.attempt_ids(5000)
    assert len(set(ids)) == 5000 and ids == sorted(ids) and min(store.attempt_ids(3, max(ids))) > max(ids)
    rows = spark.createDataFrame([("1", 1.0, "{}")], "img_id string, score double, info string")
    folder = str(tmp_path / "store")
    assert store.last_attempt(spark, folder) == 0
    store.write_report(rows, store.RunInfo("NeWT", "o", "a"), folder)
    first = store.last_attempt(spark, folder)
    monkeypatch.setattr(store.time, "time_ns", lambda: 0)
    store.write_report(rows.withColumn("score", rows.score + 1), store.RunInfo("NeWT", "o", "a"), folder)
    assert store.last_attempt(spark, folder) > first
    assert [r["score"] for r in store.read_results(spark, folder).collect()] == [2.0]


def test_files_of_a_task_are_bounded(spark, tmp_path, limits):
    limits("taskFiles", 2)
    rows = spark.range(400).selectExpr("cast(id as string) AS img_id", "1.0D AS score", "'{}' AS info").repartition(16)
    folder = tmp_path / "store"
    store.write_report(rows, store.RunInfo("NeWT", "o", "a"), str(folder))
    assert len(list((folder / "predictions").rglob("*.parquet"))) <= 2
    assert store.read_results(spark, str(folder)).count() == 400


def test_predictions_are_never_the_side_to_broadcast(spark):
    """Spark takes rows that a table repeats many times for few; the experiments seem larger before they are written."""
    predictions = spark.range(5000).select((F.col("id") % 2).alias("experiment_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("img_id"))
    every = spark.range(100_000).select((F.col("id") % 2).alias("id"), F.lit("t").alias("task_name"), F.lit("m").alias("model_ckpt"), F.lit(-1).alias("n_train"))
    joined = tables.join_results(every.distinct(), predictions)
    assert joined.count() == 500_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_size_labels_beyond_64_bits(spark, tmp_path):
    from evalspark.catalog import all_queries

    spark.createDataFrame([(200_000,), (1_200_001,), (1_200_002,)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["p_partkey"]: (r["shown"], r["range_shown"]) for r in all_queries()["size_labels"](spark, str(tmp_path)).collect()}
    sizes = {k: k**3 * 977 for k in found}
    assert {k: v[0] for k, v in found.items()} == {k: str(x) for k, x in sizes.items()}
    assert found[200_000][1] == f"{sizes[200_000]}-{2 * sizes[200_000]}" and found[1_200_001][1] == f"{sizes[1_200_001]}+"
