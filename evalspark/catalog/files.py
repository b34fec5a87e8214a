"""Sequences, sources and sinks. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import fixtures as fx
from evalspark.catalog.registry import query, rounded
from evalspark.catalog.resampling import sql_hash
from evalspark.operators import metrics, sequences
from evalspark.operators.tables import audit_md5, with_index
from evalspark.plans.report import int_labels, analysis_frame
from evalspark.scaling import shared_folder
from evalspark.sources import store, tables
from evalspark.streaming import incremental

SEED = 17
RANKED = "r AS (SELECT user_id AS video_id, event_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
ORDER = ["ts", "event_id"]

# ---- sequences -----------------------------------------------------------


@query(
    "frame_gaps",
    f"WITH {RANKED} SELECT video_id, event_id, i + 2 AS frame FROM r WHERE label = 'error'",
)
def frame_gaps(spark, sf):
    rows = with_index(fx.frames(spark, sf), ORDER, "i", ["video_id"])
    ahead = F.when(F.col("label") == "error", 1).otherwise(0)
    rows = rows.withColumn("frame", F.col("i") + 1 + ahead)
    return sequences.check_gaps(rows, "video_id", "frame", ORDER).select("video_id", "event_id", "frame")


@query("complete_videos", f"WITH {RANKED} SELECT video_id, event_id FROM r WHERE n >= 70")
def complete_videos(spark, sf):
    return sequences.complete_sequences(fx.frames(spark, sf), ["video_id"], 70).select("video_id", "event_id")


@query(
    "sample_clip",
    f"""WITH {RANKED}, s AS (SELECT *, least(5, (n - 1) // 15) AS stride FROM r WHERE n >= 16),
t AS (SELECT *, i - {sql_hash("'17'", "video_id")} % (n - (15 * stride + 1) + 1) AS o FROM s)
SELECT video_id, event_id, stride, o // stride AS clip_pos FROM t WHERE o >= 0 AND o % stride = 0 AND o < 15 * stride + 1""",
)
def sample_clip(spark, sf):
    out = sequences.sample_clip(fx.frames(spark, sf), "video_id", ORDER, 16, 5, SEED)
    return out.select("video_id", "event_id", "stride", "clip_pos")


@query(
    "sample_uniform",
    f"""WITH {RANKED}, s AS (SELECT *, greatest(n // 32, 1) AS step FROM r)
SELECT video_id, event_id, step, i // step AS clip_pos FROM s WHERE i % step = 0 AND i // step < 32""",
)
def sample_uniform(spark, sf):
    out = sequences.sample_uniform(fx.frames(spark, sf), "video_id", ORDER, 32)
    return out.select("video_id", "event_id", "step", "clip_pos")


@query(
    "label_mode",
    "SELECT user_id AS video_id, event_type AS label FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
)
def label_mode(spark, sf):
    return sequences.label_mode(fx.frames(spark, sf), ["video_id"], "label")


def segment_rows(spark, sf):
    """Orders as videos, their line items as segments (an order has a handful)."""
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end_s")).alias("s")
    )
    segments = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("vid_id"), F.col("o_totalprice").alias("duration_s"))
    return orders.join(segments, F.col("vid_id") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "number_segments",
    """WITH s AS (SELECT l_orderkey AS vid_id, l_quantity AS start_s, l_quantity + l_linenumber AS end_s,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_quantity + l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN n > 1 THEN vid_id || '_' || k ELSE CAST(vid_id AS VARCHAR) END AS clip_id, start_s, end_s FROM s""",
)
def number_segments(spark, sf):
    out = sequences.number_segments(segment_rows(spark, sf), "vid_id", "segments")
    return out.select("clip_id", "segment.start_s", "segment.end_s")


@query(
    "duration_stats",
    """SELECT round((SELECT avg(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), 6) AS mean_full_s,
round(avg(CAST(l_linenumber AS DOUBLE)), 6) AS mean_segment_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def duration_stats(spark, sf):
    return rounded(sequences.duration_stats(segment_rows(spark, sf), "duration_s", "segments"), 6)


# ---- sources and sinks ---------------------------------------------------


@query("read_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def read_csv(spark, sf):
    path = shared_folder(spark, "csv")
    rows = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows.write.option("header", True).csv(path)
    return tables.read_table(spark, path, rows.schema)


@query("read_space_delimited", "SELECT user_id AS video_id, event_id AS frame_id, event_type AS label FROM events")
def read_space_delimited(spark, sf):
    path = shared_folder(spark, "frames")
    rows = fx.frames(spark, sf).select("video_id", F.col("event_id").alias("frame_id"), "label")
    rows.write.option("sep", " ").csv(path)
    return tables.read_table(spark, path, rows.schema, sep=" ", header=False)


@query("read_space_delimited_with_header", "SELECT user_id AS video_id, event_id AS frame_id, event_type AS label FROM events")
def read_space_delimited_with_header(spark, sf):
    path = shared_folder(spark, "frames")
    rows = fx.frames(spark, sf).select("video_id", F.col("event_id").alias("frame_id"), "label")
    rows.write.option("sep", " ").option("header", True).csv(path)
    return tables.read_table(spark, path, rows.schema, sep=" ")


@query("read_json_lines", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def read_json_lines(spark, sf):
    path = shared_folder(spark, "reports")
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.write.json(path)
    return tables.read_jsonl(spark, path, rows.schema)


@query(
    "read_keyed_json",
    """SELECT 'v' || s_suppkey AS vid_id, CAST(s_nationkey * 10 + 100 AS INTEGER) AS width, CAST(s_suppkey + 1 AS INTEGER) AS height, round(s_acctbal, 2) AS duration_s,
CAST(s_nationkey AS DOUBLE) AS start_s, s_nationkey + 2.5e0 AS end_s, s_name AS label FROM supplier""",
)
def read_keyed_json(spark, sf):
    path = shared_folder(spark, "videos")
    start = F.col("s_nationkey").cast("double")
    value = F.struct(
        F.array(F.struct(F.col("s_name").alias("label"), F.array(start, start + 2.5).alias("segment"))).alias("annotations"),
        F.round("s_acctbal", 2).alias("duration"),
        F.concat_ws("x", (F.col("s_nationkey") * 10 + 100).cast("string"), (F.col("s_suppkey") + 1).cast("string")).alias("resolution"),
        F.lit(30).alias("fps"),
    )
    entry = F.map_from_arrays(F.array(F.concat(F.lit("v"), F.col("s_suppkey").cast("string"))), F.array(value))
    fx.table(spark, sf, "supplier").select(F.to_json(entry).alias("value")).write.text(path)
    videos = tables.read_videos(spark, path, one_per_line=True)
    return videos.select("vid_id", "resolution.width", "resolution.height", "duration_s", F.explode("annotations").alias("a")).select(
        "vid_id", "width", "height", "duration_s", "a.start_s", "a.end_s", "a.label"
    )


@query(
    "read_coco",
    "SELECT CAST(p_partkey AS VARCHAR) AS img_id, p_name || '.jpg' AS file_name, p_brand AS label FROM part",
)
def read_coco(spark, sf):
    path = shared_folder(spark, "coco")
    image = F.struct(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".jpg")).alias("file_name"))
    note = F.struct(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("name"))
    # One annotation file per hundred parts.
    docs = fx.table(spark, sf, "part").groupBy(F.expr("p_partkey div 100")).agg(
        F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations")
    )
    docs.select(F.to_json(F.struct("images", "annotations")).alias("value")).write.text(path)
    return tables.read_coco(spark, path, one_per_line=True)


@query("read_coco_documents", "SELECT CAST(p_partkey AS VARCHAR) AS img_id, p_name || '.jpg' AS file_name, p_brand AS label FROM part")
def read_coco_documents(spark, sf):
    """One file of many lines per part size."""
    path = shared_folder(spark, "coco")
    image = F.struct(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".jpg")).alias("file_name"))
    note = F.struct(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("name"))
    docs = fx.table(spark, sf, "part").groupBy("p_size").agg(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations"))
    text = F.to_json(F.struct("images", "annotations"), {"pretty": "true"})
    docs.select(text.alias("value"), "p_size").write.partitionBy("p_size").text(path)
    return tables.read_coco(spark, path)


@query("read_keyed_json_documents", "SELECT 'v' || s_suppkey AS vid_id, round(s_acctbal, 2) AS duration, s_name AS url FROM supplier")
def read_keyed_json_documents(spark, sf):
    """One file of many lines per nation."""
    path = shared_folder(spark, "videos")
    value = F.struct(F.round("s_acctbal", 2).alias("duration"), F.col("s_name").alias("url"))
    entry = F.struct(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("key"), value.alias("value"))
    docs = fx.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(entry)).alias("doc"))
    text = F.to_json("doc", {"pretty": "true"})
    docs.select(text.alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    return tables.read_keyed_json(spark, path, "struct<duration:double,url:string>", "vid_id")


@query(
    "path_examples",
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?].*$', '') AS path FROM pages), s AS (SELECT page_id, regexp_replace(path, '^.*/', '') AS base, split_part(path, '/', -2) AS label FROM p)
SELECT page_id, label, regexp_replace(base, '(.)[.][^.]*$', '\\1') AS img_id FROM s""",
)
def path_examples(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?].*$", "").alias("path"))
    return tables.example_paths(pages, F.col("path")).select("page_id", "label", "img_id")


@query("scan_folder_tree", "SELECT DISTINCT 'c_mktsegment=' || c_mktsegment AS label, '.txt' AS suffix FROM customer")
def scan_folder_tree(spark, sf):
    path = shared_folder(spark, "tree")
    fx.table(spark, sf, "customer").select("c_name", "c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    return tables.scan_tree(spark, path, "*.txt").select("label", "suffix").distinct()


@query(
    "read_bytes_table",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, md5(text) AS digest FROM documents",
)
def read_bytes_table(spark, sf):
    rows = tables.read_bytes_table(spark, f"{sf}/documents.parquet")
    return rows.select("doc_id", F.col("index").alias("idx"), F.md5(F.col("text").cast("binary")).alias("digest"))


STORE = f"WITH {fx.PREDS}"


def write_store(spark, sf):
    """A results store with one run per model and task, written in one pass."""
    folder = shared_folder(spark, "store")
    info = store.prediction_info(F.col("y_true"), F.col("y_pred")).alias("info")
    rows = fx.predictions(spark, sf).select("task_name", "model_ckpt", "img_id", "score", info)
    runs = [store.RunInfo(task, "demo", f"m{k}", posix=1.0) for k in range(fx.MODELS) for task in ("F", "O", "P")]
    store.write_reports(rows, runs, folder)
    return folder


@query(
    "results_store_round_trip",
    STORE + " SELECT lower(task_name) AS task_name, model_ckpt, img_id, y_true, y_pred FROM preds",
)
def results_store_round_trip(spark, sf):
    rows = int_labels(analysis_frame(store.read_results(spark, write_store(spark, sf))))
    return rows.select("task_name", "model_ckpt", "img_id", "y_true", "y_pred")


@query(
    "streaming_mean_score",
    STORE
    + """ SELECT lower(task_name) AS task_name, model_ckpt, round(avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END), 9) AS mean_score, count(*) AS n
FROM preds GROUP BY 1, 2""",
)
def streaming_mean_score(spark, sf):
    folder = write_store(spark, sf)
    scores = incremental.running_mean(incremental.prediction_stream(spark, folder))
    running = incremental.start(scores, "running_scores", shared_folder(spark, "stream"))
    running.awaitTermination()
    runs = store.read_experiments(spark, folder).select(F.col("id").alias("experiment_id"), "model_ckpt")
    return rounded(spark.table("running_scores").join(runs, "experiment_id").drop("experiment_id"))


@query(
    "results_document",
    f"""WITH {fx.PREDS}, b AS (SELECT task_name, model_ckpt, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS v FROM preds GROUP BY 1, 2)
SELECT task_name AS task, model_ckpt AS model, round(v, 9) AS mean, first_value(model_ckpt) OVER (PARTITION BY task_name ORDER BY v DESC, model_ckpt) AS best, 17 AS seed FROM b""",
)
def results_document(spark, sf):
    means = metrics.mean_score(fx.predictions(spark, sf), ["task_name", "model_ckpt"])
    scores = means.toDF("task", "model", "mean")
    best = F.max_by("model", F.struct("mean", F.lit(0)))
    bests = scores.groupBy("task").agg(best.alias("best")).withColumn("ties", F.array("best"))
    models = scores.select(F.col("model").alias("ckpt")).distinct()
    names = scores.select(F.col("task").alias("name"), F.col("task").alias("display")).distinct()
    meta = {"schema": 1, "generated": 0, "git_commit": "", "seed": SEED, "alpha": 0.05, "n_bootstraps": 0}
    path = shared_folder(spark, "results")
    store.write_results_json(store.results_document(scores, bests, models, names, names.limit(0), meta), path)
    shape = (
        "meta struct<seed:int>, results array<struct<task:string,model:string,mean:double>>,"
        "bests array<struct<task:string,best:string,ties:array<string>>>"
    )
    doc = spark.read.schema(shape).json(path)
    out = doc.select(F.col("meta.seed").alias("seed"), F.explode("results").alias("r"), "bests")
    best_of = F.get(F.filter("bests", lambda b: b["task"] == F.col("r.task")), F.lit(0))["best"]
    return rounded(out.select("r.task", "r.model", "r.mean", best_of.alias("best"), "seed"))


@query(
    "read_wide_results",
    f"""WITH {fx.WIDE} SELECT CASE model WHEN 's1' THEN 'Supplier One' ELSE model END AS "Model", "A", "R" AS "Last", round(mean, 9) AS "Mean" FROM complete""",
)
def read_wide_results(spark, sf):
    path = shared_folder(spark, "wide")
    rows = rounded(fx.complete(spark, sf))
    rows.write.option("header", True).csv(path)
    return tables.read_wide_results(
        spark, path, rows.schema, drop=["N"], rename={"mean": "Mean", "model": "Model", "R": "Last"}, names={"s1": "Supplier One"}
    )


@query(
    "audit_md5",
    """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 50 = 0 THEN 'mismatch' WHEN doc_id % 50 = 1 THEN 'unlisted' WHEN doc_id % 50 = 2 THEN 'missing' ELSE 'ok' END AS status FROM documents""",
)
def audit(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    digest = F.when(F.col("doc_id") % 50 == 0, F.md5(F.lit("other"))).otherwise(F.md5("content"))
    manifest = docs.where("doc_id % 50 <> 1").select("name", digest.alias("md5"))
    files = docs.where("doc_id % 50 <> 2").select("name", "content")
    return audit_md5(files, manifest).select("name", "status")
