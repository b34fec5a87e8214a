"""Results store, predicates, joins and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import fixtures as fx
from evalspark.catalog.registry import query, rounded
from evalspark.functions import labels, text
from evalspark.operators import bootstrap, costs, metrics, tables
from evalspark.plans import backlog, report
from evalspark.sources.store import prediction_info

BY = ["task_name", "model_ckpt"]
KEYS = "task_name, model_ckpt"


def analysis(spark, sf):
    """Stored predictions joined with their experiments, parsed and cast."""
    joined = tables.join_results(fx.experiments(spark, sf), fx.stored_predictions(spark, sf))
    return report.int_labels(report.analysis_frame(joined)).drop("ood")


F1_SQL = """
cls AS (
  SELECT task_name, model_ckpt, label, sum(tp) AS tp, sum(t) + sum(p) AS total
  FROM (
    SELECT task_name, model_ckpt, y_true AS label, 1 AS t, 0 AS p, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp FROM {src}
    UNION ALL
    SELECT task_name, model_ckpt, y_pred, 0, 1, 0 FROM {src}
  ) GROUP BY 1, 2, 3
)"""


@query(
    "flagship_macro_f1",
    f"""WITH {fx.EXPERIMENTS},
known AS (SELECT p.* FROM preds p JOIN experiments e ON e.task_name = p.task_name AND e.model_ckpt = p.model_ckpt WHERE e.n_train = -1),
{F1_SQL.format(src="known")},
f1 AS (SELECT {KEYS}, sum(2e0 * tp / total) / (max(label) + 1) AS macro_f1 FROM cls GROUP BY 1, 2),
acc AS (SELECT {KEYS}, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS micro_acc FROM known GROUP BY 1, 2)
SELECT f1.task_name, f1.model_ckpt, round(macro_f1, 9) AS macro_f1, round(micro_acc, 9) AS micro_acc
FROM f1 JOIN acc USING (task_name, model_ckpt)""",
)
def flagship_macro_f1(spark, sf):
    scored = metrics.summary(analysis(spark, sf), BY)
    board = rounded(scored.select(*BY, "macro_f1", "micro_acc"))
    return board.orderBy("task_name", F.desc("macro_f1"), "model_ckpt")


@query(
    "join_experiments",
    f"""WITH {fx.EXPERIMENTS}
SELECT e.task_name, e.model_ckpt, e.n_train, count(*) AS n, sum(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS hits
FROM preds p JOIN experiments e ON e.task_name = p.task_name AND e.model_ckpt = p.model_ckpt GROUP BY 1, 2, 3""",
)
def join_experiments(spark, sf):
    joined = tables.join_results(fx.experiments(spark, sf), fx.stored_predictions(spark, sf))
    return joined.groupBy(*BY, "n_train").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("hits"))


@query(
    "filter_known_runs",
    f"""WITH {fx.EXPERIMENTS}
SELECT p.task_name, p.model_ckpt, count(*) AS n FROM preds p
JOIN experiments e ON e.task_name = p.task_name AND e.model_ckpt = p.model_ckpt
WHERE e.n_train = -1 AND p.task_name IN ('F', 'O') AND p.model_ckpt IN ('m0', 'm2', 'm5', 'm7') GROUP BY 1, 2""",
)
def filter_known_runs(spark, sf):
    joined = tables.join_results(fx.experiments(spark, sf), fx.stored_predictions(spark, sf))
    known = tables.filter_known(joined, ["F", "O"], ["m0", "m2", "m5", "m7"])
    return known.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_json_labels",
    f"WITH {fx.PREDS} SELECT img_id, 100 * k + ascii(task_name) AS experiment_id, CAST(y_true AS VARCHAR) AS y_true, CAST(y_pred AS VARCHAR) AS y_pred FROM preds",
)
def parse_json_labels(spark, sf):
    parsed = labels.parse_info(fx.stored_predictions(spark, sf))
    return parsed.select("img_id", "experiment_id", "y_true", "y_pred")


@query(
    "cast_text_labels",
    "SELECT o_orderkey, CAST(o_custkey % 20 AS INTEGER) AS from_int, CAST(o_custkey % 20 AS INTEGER) AS from_float FROM orders",
)
def cast_text_labels(spark, sf):
    label = (F.col("o_custkey") % 20).cast("string")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        labels.cast_label(label).alias("from_int"),
        labels.cast_label(F.concat(label, F.lit(".0"))).alias("from_float"),
    )


@query(
    "correctness_flag",
    f"WITH {fx.PREDS} SELECT {KEYS}, img_id, CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END AS correct FROM preds",
)
def correctness_flag(spark, sf):
    return fx.predictions(spark, sf).select(*BY, "img_id", labels.correctness().alias("correct"))


@query(
    "require_all_columns",
    """SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND nullif(toxic, 1) IS NOT NULL""",
)
def require_all_columns(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.withColumn("toxic", F.when(F.col("toxic") != 1, F.col("toxic")))
    return tables.require_all(rows, ["quality", "toxic"])


@query(
    "encode_binary_labels",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS strict_code,
CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS INTEGER) AS lenient_code FROM lineitem""",
)
def encode_binary_labels(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        labels.encode_binary(F.col("l_linestatus"), "O", "F").alias("strict_code"),
        labels.encode_binary(F.col("l_returnflag"), "N", "A", strict=False).alias("lenient_code"),
    )


@query(
    "nonempty_paths",
    "SELECT doc_id, source FROM documents WHERE CASE WHEN lang = 'fr' THEN '' ELSE source END <> ''",
)
def nonempty_paths(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = rows.withColumn("path", F.when(F.col("lang") == "fr", "").otherwise(F.col("source")))
    return tables.nonempty(rows, "path").select("doc_id", "source")


@query(
    "split_masks",
    """SELECT 'train' AS part, event_type, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 2
UNION ALL SELECT 'test', event_type, count(*) FROM events WHERE event_id % 5 = 0 GROUP BY 2""",
)
def split_masks(spark, sf):
    rows = fx.table(spark, sf, "events").withColumn("split", F.when(F.col("event_id") % 5 != 0, "train").otherwise("test"))
    train, test = tables_split(rows)
    return train.unionByName(test)


def tables_split(rows):
    from evalspark.operators.sampling import split_frames

    parts = split_frames(rows)
    return tuple(
        part.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "event_type", "n")
        for name, part in zip(("train", "test"), parts)
    )


STALE_NOW = 10_957 + 365  # day number used as "now" against order dates


@query(
    "stale_claims",
    f"""SELECT o_orderkey AS id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 3600 AS posix FROM orders
WHERE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 3600 < {STALE_NOW * 3600} - 72 * 3600""",
)
def stale_claims(spark, sf):
    claims = fx.run_times(spark, sf).select("id", (F.col("posix") * 3600).alias("posix"))
    return tables.stale_rows(claims, STALE_NOW * 3600, 72)


@query(
    "flatten_struct_column",
    "SELECT c_custkey, c_name AS customer_name, c_acctbal AS customer_balance FROM customer",
)
def flatten_struct_column(spark, sf):
    packed = fx.table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("args")
    )
    return tables.flatten_struct(packed, "args", "customer")


@query(
    "dimension_lookup",
    f"""WITH {fx.SCORES}, {fx.DIMS}
SELECT task, model, round(mean, 9) AS mean, family, resolution, params FROM scores LEFT JOIN dims ON model = model_ckpt""",
)
def dimension_lookup(spark, sf):
    rows = fx.scores(spark, sf).withColumnRenamed("model", "model_ckpt")
    out = tables.with_dims(rows, models=fx.dims(spark, sf)).withColumnRenamed("model_ckpt", "model")
    return rounded(out.select("task", "model", "mean", "family", "resolution", "params"))


@query(
    "flag_out_of_distribution",
    "SELECT vec_id AS id, label, label >= 8 AS ood FROM embeddings",
)
def flag_out_of_distribution(spark, sf):
    rows = fx.embeddings(spark, sf).select("id", "label")
    return tables.flag_ood(rows, rows.where("label < 8"))


BACKLOG = """
grid AS (SELECT 'org' || c_nationkey AS model_org, 'c' || c_custkey AS model_ckpt, n AS n_train FROM customer, (SELECT unnest([-1, 100]) AS n)),
tasks AS (SELECT lower(o_orderpriority) AS task_name, CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE '/data' END AS data_root,
  o_orderpriority NOT LIKE '4%' AS has_code FROM (SELECT DISTINCT o_orderpriority FROM orders)),
runs AS (SELECT lower(o_orderpriority) AS task_name, 'org' || c_nationkey AS model_org, 'c' || c_custkey AS model_ckpt, -1 AS n_train, o_orderstatus AS s
  FROM orders JOIN customer ON o_custkey = c_custkey),
reasons AS (
  SELECT g.model_ckpt, t.task_name, g.n_train,
    CASE WHEN NOT has_code THEN 'no code' WHEN data_root = '' THEN 'no data'
      WHEN EXISTS (SELECT 1 FROM runs r WHERE s = 'F' AND r.task_name = t.task_name AND r.model_org = g.model_org AND r.model_ckpt = g.model_ckpt AND r.n_train = g.n_train) THEN 'done'
      WHEN EXISTS (SELECT 1 FROM runs r WHERE s = 'P' AND r.task_name = t.task_name AND r.model_org = g.model_org AND r.model_ckpt = g.model_ckpt AND r.n_train = g.n_train) THEN 'queued'
      ELSE 'todo' END AS reason
  FROM grid g, tasks t
)"""


def backlog_tables(spark, sf):
    customer, orders = fx.table(spark, sf, "customer"), fx.table(spark, sf, "orders")
    names = customer.select(
        "c_custkey",
        F.concat(F.lit("org"), F.col("c_nationkey").cast("string")).alias("model_org"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model_ckpt"),
    )
    grid = tables.expand_grid(names.drop("c_custkey"), {"n_train": [-1, 100]})
    kinds = orders.select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("task_name"),
        F.when(F.col("o_orderpriority").like("5%"), "").otherwise("/data").alias("data_root"),
        (~F.col("o_orderpriority").like("4%")).alias("has_code"),
    )
    runs = orders.join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("task_name"), "model_org", "model_ckpt", F.lit(-1).alias("n_train"), "o_orderstatus"
    )
    done, claims = runs.where("o_orderstatus = 'F'"), runs.where("o_orderstatus = 'P'")
    return backlog.wanted_runs(grid, kinds), done, claims


@query("backlog_reasons", f"WITH {BACKLOG} SELECT task_name, model_ckpt, n_train, reason FROM reasons")
def backlog_reasons(spark, sf):
    out = backlog.backlog(*backlog_tables(spark, sf))
    return out.select("task_name", "model_ckpt", "n_train", "reason")


@query("backlog_todo", f"WITH {BACKLOG} SELECT task_name, model_ckpt, n_train FROM reasons WHERE reason = 'todo'")
def backlog_todo(spark, sf):
    return backlog.todo(*backlog_tables(spark, sf)).select("task_name", "model_ckpt", "n_train")


@query("backlog_summary", f"WITH {BACKLOG} SELECT reason, count(*) AS n FROM reasons GROUP BY ROLLUP (reason)")
def backlog_summary(spark, sf):
    return backlog.summarize_backlog(backlog.backlog(*backlog_tables(spark, sf)))


@query(
    "backlog_by_model",
    f"WITH {BACKLOG} SELECT model_ckpt, count(*) AS n FROM reasons WHERE reason = 'todo' GROUP BY 1",
)
def backlog_by_model(spark, sf):
    return backlog.todo_by_model(backlog.backlog(*backlog_tables(spark, sf)))


@query(
    "config_grid",
    """SELECT 's' || s_suppkey AS ckpt, debug, n_train, 17 AS seed FROM supplier,
(SELECT unnest([true, false]) AS debug), (SELECT unnest([-1, 10, 100]) AS n_train)""",
)
def config_grid(spark, sf):
    models = fx.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ckpt"))
    return tables.expand_grid(models, {"debug": [True, False], "n_train": [-1, 10, 100], "seed": 17})


@query(
    "resolve_file_case",
    """WITH files AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || p_partkey ELSE lower(p_name || p_partkey) END AS file FROM part),
want AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name || p_partkey) ELSE p_name || p_partkey END AS name FROM part)
SELECT p_partkey, name, coalesce(e.file, l.file) AS path FROM want LEFT JOIN files e ON e.file = name LEFT JOIN files l ON l.file = lower(name)""",
)
def resolve_file_case(spark, sf):
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    part = fx.table(spark, sf, "part").select("p_partkey", name.alias("name"))
    files = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.lower("name")).alias("file"))
    wanted = part.withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.upper("name")).otherwise(F.col("name")))
    return tables.resolve_path(wanted, files)


@query(
    "match_annotation_files",
    """SELECT o_orderkey, coalesce(n, 0) AS n_files,
CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 3 THEN 'incomplete' ELSE 'ok' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def match_annotation_files(spark, sf):
    notes = fx.table(spark, sf, "orders").select("o_orderkey")
    files = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.match_files(notes, files, "o_orderkey", min_files=3)


# ---- metrics -------------------------------------------------------------


def metric(name, fn, sql, source=fx.predictions, **options):
    """Register a metric grouped by task and model."""

    @query(name, sql)
    def run(spark, sf):
        return rounded(fn(source(spark, sf), BY, **options))

    return run


metric(
    "micro_accuracy",
    metrics.micro_acc,
    f"WITH {fx.PREDS} SELECT {KEYS}, round(avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END), 9) AS value FROM preds GROUP BY 1, 2",
)
metric(
    "balanced_accuracy",
    metrics.macro_acc,
    f"""WITH {fx.PREDS}, r AS (SELECT {KEYS}, y_true, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS v FROM preds GROUP BY 1, 2, 3)
SELECT {KEYS}, round(avg(v), 9) AS value FROM r GROUP BY 1, 2""",
)
metric(
    "micro_f1",
    metrics.micro_f1,
    f"WITH {fx.PREDS}, {F1_SQL.format(src='preds')} SELECT {KEYS}, round(2e0 * sum(tp) / sum(total), 9) AS value FROM cls GROUP BY 1, 2",
)
metric(
    "macro_f1_dense",
    metrics.macro_f1,
    f"WITH {fx.PREDS}, {F1_SQL.format(src='preds')} SELECT {KEYS}, round(sum(2e0 * tp / total) / (max(label) + 1), 9) AS value FROM cls GROUP BY 1, 2",
)
metric(
    "macro_f1_fixed_classes",
    metrics.macro_f1,
    f"WITH {fx.PREDS}, {F1_SQL.format(src='preds')} SELECT {KEYS}, round(sum(2e0 * tp / total) / 25, 9) AS value FROM cls GROUP BY 1, 2",
    n_classes=25,
)
metric(
    "macro_f1_present",
    metrics.macro_f1,
    f"WITH {fx.UNKNOWN_PREDS}, {F1_SQL.format(src='upreds')} SELECT {KEYS}, round(avg(2e0 * tp / total), 9) AS value FROM cls GROUP BY 1, 2",
    source=fx.unknown_predictions,
    present_only=True,
)
metric(
    "mean_score",
    metrics.mean_score,
    f"WITH {fx.PREDS} SELECT {KEYS}, round(avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END), 9) AS value FROM preds GROUP BY 1, 2",
)
TRAIT_F1 = """
f1 AS (
  SELECT task_name, model_ckpt, trait, sum(2e0 * tp / total) / 2 AS v FROM (
    SELECT task_name, model_ckpt, trait, label, sum(tp) AS tp, count(*) AS total FROM (
      SELECT task_name, model_ckpt, trait, y_true AS label, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp FROM traits
      UNION ALL SELECT task_name, model_ckpt, trait, y_pred, 0 FROM traits
    ) GROUP BY 1, 2, 3, 4
  ) GROUP BY 1, 2, 3
)"""
metric(
    "multilabel_macro_f1",
    metrics.multilabel_macro_f1,
    f"WITH {fx.TRAITS}, {TRAIT_F1} SELECT {KEYS}, round(avg(v), 9) AS value FROM f1 GROUP BY 1, 2",
    source=fx.traits,
)

COST = """
cost AS (
  SELECT task_name, model_ckpt, count(*) AS n,
    sum(CASE WHEN y_true <> y_pred AND y_true <> -1 AND y_pred <> -1 THEN 1e0 ELSE 0e0 END) AS other,
    sum(CASE WHEN y_true = -1 AND y_pred <> -1 THEN 1e0 ELSE 0e0 END) AS as_known,
    sum(CASE WHEN y_true <> -1 AND y_pred = -1 THEN 1e0 ELSE 0e0 END) AS as_unknown,
    sum(CASE WHEN y_true IN (1, 3) AND y_pred NOT IN (1, 3) THEN 1 ELSE 0 END) AS psc,
    sum(CASE WHEN y_true NOT IN (1, 3) AND y_pred IN (1, 3) THEN 1 ELSE 0 END) AS esc,
    sum(CASE WHEN y_true = -1 THEN 1e0 ELSE 0e0 END) AS unknown,
    sum(CASE WHEN y_true IN (1, 3) THEN 1e0 ELSE 0e0 END) AS harmful
  FROM upreds GROUP BY 1, 2
)"""
CE_UNK = "(other + 10e0 * as_known + 1e-1 * as_unknown) / n"
HARM = "(1e2 * psc + 1e0 * esc) / n"
WORST = "(9e0 * unknown / n + 1 + (1e2 * harmful + (n - harmful)) / n)"


def cost_sql(value: str) -> str:
    return f"WITH {fx.UNKNOWN_PREDS}, {COST} SELECT {KEYS}, round({value}, 9) AS value FROM cost"


metric("unknown_error", costs.unknown_error, cost_sql(CE_UNK), fx.unknown_predictions)
metric("class_error", costs.class_error, cost_sql("(other + as_known + as_unknown) / n"), fx.unknown_predictions)
metric(
    "psc_esc_counts",
    costs.psc_esc,
    f"WITH {fx.UNKNOWN_PREDS}, {COST} SELECT {KEYS}, CAST(psc AS BIGINT) AS psc, CAST(esc AS BIGINT) AS esc FROM cost",
    fx.unknown_predictions,
    harmful=fx.HARMFUL,
)
metric("psc_esc_cost", costs.psc_esc_cost, cost_sql(HARM), fx.unknown_predictions, harmful=fx.HARMFUL)
metric("user_loss", costs.user_loss, cost_sql(f"{CE_UNK} + {HARM}"), fx.unknown_predictions, harmful=fx.HARMFUL)
metric(
    "user_loss_normalized",
    costs.user_loss_norm,
    cost_sql(f"1 - ({CE_UNK} + {HARM}) / {WORST}"),
    fx.unknown_predictions,
    harmful=fx.HARMFUL,
)


# Classes 15 to 19 were not seen in training.
UNSEEN = fx.PREDS + ", upreds AS (SELECT task_name, model_ckpt, img_id, CASE WHEN y_true >= 15 THEN -1 ELSE y_true END AS y_true, y_pred FROM preds)"


@query(
    "user_loss_unseen_classes",
    f"WITH {UNSEEN}, {COST} SELECT task_name AS task, model_ckpt AS model, round(1 - ({CE_UNK} + {HARM}) / {WORST}, 9) AS mean FROM cost",
)
def user_loss_unseen_classes(spark, sf):
    rows = fx.predictions(spark, sf)
    info = prediction_info(F.col("y_true"), F.col("y_pred"), ood=F.col("y_true") >= 15)
    stored = rows.select("img_id", "score", info.alias("info"), fx.experiment_id().alias("experiment_id"))
    # Every run counts here, whatever it was trained on.
    runs = fx.experiments(spark, sf).withColumn("n_train", F.lit(-1))
    parsed = report.analysis_frame(tables.join_results(runs, stored))
    kinds = {"F": "user_loss", "O": "user_loss", "P": "user_loss"}
    scores, _ = report.calc_scores(parsed, 20, method="poisson", task_scores=kinds, harmful=fx.HARMFUL)
    return rounded(scores.select("task", "model", "mean"))


@query(
    "cost_report",
    f"""WITH {fx.UNKNOWN_PREDS}, {COST}, {F1_SQL.format(src="upreds")},
f1 AS (SELECT {KEYS}, avg(2e0 * tp / total) * 100 AS f1_macro FROM cls GROUP BY 1, 2)
SELECT cost.task_name, cost.model_ckpt, round(f1_macro, 9) AS f1_macro, round((other + as_known + as_unknown) / n, 9) AS ce,
round({HARM}, 9) AS psc_esc_cost, round({CE_UNK}, 9) AS ce_unk, round({CE_UNK} + {HARM}, 9) AS user_loss
FROM cost JOIN f1 USING (task_name, model_ckpt)""",
)
def cost_report(spark, sf):
    return rounded(costs.cost_report(fx.unknown_predictions(spark, sf), BY, fx.HARMFUL))


@query(
    "harmful_class_table",
    f"""WITH {fx.PREDS}, bad AS (SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS c FROM nation WHERE n_regionkey = 2)
SELECT {KEYS}, count(*) FILTER (WHERE y_true IN (SELECT c FROM bad) AND y_pred NOT IN (SELECT c FROM bad)) AS psc,
count(*) FILTER (WHERE y_true NOT IN (SELECT c FROM bad) AND y_pred IN (SELECT c FROM bad)) AS esc FROM preds GROUP BY 1, 2""",
)
def harmful_class_table(spark, sf):
    bad = fx.table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("class_id"))
    return costs.psc_esc(fx.predictions(spark, sf), BY, bad)


@query("class_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def class_counts(spark, sf):
    from evalspark.operators.longtail import class_counts as counts

    rows = fx.table(spark, sf, "events").select(F.col("event_type").alias("label"))
    return counts(rows, [], "label")


@query(
    "equal_row_counts",
    f"""WITH {fx.PREDS}, s AS (SELECT model_ckpt, count(*) AS n FROM preds GROUP BY 1)
SELECT min(n) AS min_n, max(n) AS max_n, min(n) = max(n) AS consistent FROM s""",
)
def equal_row_counts(spark, sf):
    return metrics.check_equal_n(fx.predictions(spark, sf), ["model_ckpt"])


@query(
    "dedup_predictions",
    f"WITH {fx.PREDS} SELECT {KEYS}, img_id, y_true, y_pred FROM preds",
)
def dedup_predictions(spark, sf):
    rows = fx.predictions(spark, sf).drop("k")
    return bootstrap.dedup_predictions(rows.unionByName(rows)).select(*BY, "img_id", "y_true", "y_pred")


@query(
    "latest_runs",
    """WITH r AS (SELECT 'c' || o_custkey AS model_ckpt, o_orderpriority AS task_name, o_totalprice AS mean_score,
date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS posix,
row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders)
SELECT model_ckpt, task_name, mean_score, posix FROM r WHERE rn = 1""",
)
def latest_runs(spark, sf):
    return tables.latest(fx.run_times(spark, sf), ["model_ckpt", "task_name"], "mean_score")


@query(
    "unknown_checkpoints",
    "SELECT DISTINCT 'c' || o_custkey AS model_ckpt FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def unknown_checkpoints(spark, sf):
    stored = fx.run_times(spark, sf)
    known = fx.table(spark, sf, "customer").where("c_acctbal > 0")
    known = known.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model_ckpt"))
    return tables.unknown_models(stored, known)


@query(
    "common_tasks",
    "SELECT DISTINCT event_type AS task_name FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 50)",
)
def common_tasks(spark, sf):
    events = fx.table(spark, sf, "events").withColumnRenamed("event_type", "task_name")
    return tables.common_tasks(events, events.where("value > 50"))


@query(
    "label_universe",
    "SELECT DISTINCT l_partkey AS label FROM lineitem UNION SELECT p_partkey FROM part",
)
def label_universe(spark, sf):
    train = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("label"))
    val = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("label"))
    return tables.label_universe(train, val, "label")


@query(
    "row_index",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents",
)
def row_index(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return tables.with_index(docs, ["doc_id"], "idx", ["source"])


@query(
    "global_row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders",
)
def global_row_index(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return tables.with_index(orders, ["o_orderdate", "o_orderkey"], "idx").drop("o_orderdate")


@query(
    "encode_labels_sorted",
    "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS y FROM part",
)
def encode_labels_sorted(spark, sf):
    return tables.encode_labels(fx.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@query(
    "encode_labels_first_seen",
    """WITH c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS y FROM part GROUP BY 1)
SELECT p_partkey, p_type, y FROM part JOIN c USING (p_type)""",
)
def encode_labels_first_seen(spark, sf):
    part = fx.table(spark, sf, "part").select("p_partkey", "p_type")
    return tables.encode_labels(part, "p_type", order="first", arrival="p_partkey")


@query(
    "balanced_class_weights",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, event_type, round((SELECT CAST(sum(n) AS DOUBLE) / count(*) FROM c) / n, 9) AS weight FROM events JOIN c USING (event_type)""",
)
def balanced_class_weights(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "event_type")
    return rounded(tables.balanced_weights(rows, "event_type"))


@query(
    "aligned_by_id",
    f"WITH {fx.PREDS} SELECT model_ckpt, img_id, y_pred, row_number() OVER (PARTITION BY model_ckpt ORDER BY img_id) - 1 AS position FROM preds",
)
def aligned_by_id(spark, sf):
    return tables.align(fx.predictions(spark, sf), ["model_ckpt"], "img_id", "y_pred")


# ---- scalar functions ----------------------------------------------------


@query(
    "safe_names",
    "SELECT page_id, replace(replace(url, ':', '_'), '/', '_') AS name FROM pages",
)
def safe_names(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.fs_safe(F.col("url")).alias("name"))


@query(
    "checkpoint_names",
    """SELECT p_partkey, replace(p_name, ' ', '_') || '_vit' AS ckpt FROM part""",
)
def checkpoint_names(spark, sf):
    path = F.concat(
        F.lit("/models/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_vit_pretrain_lvd1689m-"), F.md5("p_name"), F.lit(".pth")
    )
    return fx.table(spark, sf, "part").select("p_partkey", text.pretrain_ckpt(path).alias("ckpt"))


@query(
    "taxon_labels",
    """SELECT p_partkey, p_brand || '|' || p_type || '|' || CASE WHEN p_size > 25 THEN '' ELSE p_name END AS label FROM part""",
)
def taxon_labels(spark, sf):
    name = F.when(F.col("p_size") <= 25, F.col("p_name"))
    return fx.table(spark, sf, "part").select("p_partkey", text.taxon_label(F.col("p_brand"), F.col("p_type"), name).alias("label"))


@query(
    "path_parts",
    """WITH b AS (SELECT page_id, regexp_replace(url, '^.*/', '') || '.jpg' AS base, split_part(url, '/', -2) AS parent FROM pages)
SELECT page_id, base, CASE WHEN base = '.jpg' THEN base ELSE left(base, length(base) - 4) END AS stem,
CASE WHEN base = '.jpg' THEN '' ELSE '.jpg' END AS suffix, parent FROM b""",
)
def path_parts(spark, sf):
    path = F.concat("url", F.lit(".jpg"))
    return fx.table(spark, sf, "pages").select(
        "page_id",
        text.base_name(path).alias("base"),
        text.stem(path).alias("stem"),
        text.suffix(path).alias("suffix"),
        text.parent_name(path).alias("parent"),
    )


@query(
    "release_dates",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', d) * 86400000 AS release_ms,
CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE
 ['Jan', 'Feb', 'March', 'April', 'May', 'June', 'July', 'Aug', 'Sept', 'Oct', 'Nov', 'Dec'][month(d)] || ' ' || year(d) END AS month_year FROM d""",
)
def release_dates(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", text.epoch_ms(F.col("o_orderdate")).alias("release_ms"))
    shown = F.when(F.col("o_orderkey") % 10 != 0, F.col("release_ms"))
    return orders.withColumn("month_year", text.month_year(shown))


@query(
    "percent_labels",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN '-' ELSE printf('%.1f', round(l_discount * 100, 1)) END AS shown FROM lineitem",
)
def percent_labels(spark, sf):
    score = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.percent_label(score).alias("shown"))


BIG = """CASE WHEN {x} < 1000 THEN CAST({x} AS VARCHAR) WHEN {x} < 1000000 THEN CAST({x} // 1000 AS VARCHAR) || 'K'
WHEN {x} < 1000000000 THEN CAST({x} // 1000000 AS VARCHAR) || 'M' WHEN {x} < 1000000000000 THEN CAST({x} // 1000000000 AS VARCHAR) || 'B'
ELSE CAST({x} AS VARCHAR) END"""


@query(
    "size_labels",
    f"""WITH v AS (SELECT p_partkey, p_partkey * p_partkey * p_partkey * 977 AS x FROM part)
SELECT p_partkey, {BIG.format(x="x")} AS shown,
CASE WHEN p_partkey % 3 = 0 THEN '<' || {BIG.format(x="x")} WHEN p_partkey % 3 = 1 THEN {BIG.format(x="x")} || '+'
ELSE {BIG.format(x="x")} || '-' || {BIG.format(x="(x * 2)")} END AS range_shown FROM v""",
)
def size_labels(spark, sf):
    # Cubes of keys from 211,321 on are beyond 64 bits.
    key = F.col("p_partkey").cast("decimal(20,0)")
    rows = fx.table(spark, sf, "part").select("p_partkey", (key * key * key * 977).alias("x"))
    low = F.when(key % 3 == 0, F.lit(0)).otherwise(F.col("x"))
    high = F.when(key % 3 == 0, F.col("x")).when(key % 3 == 1, F.lit(text.UPPER_LIMIT)).otherwise(F.col("x") * 2)
    # A zero lower bound means "below"; part 0 has size 0 and keeps the same label.
    return rows.select("p_partkey", text.big_int_label(F.col("x")).alias("shown"), text.range_label(low, high).alias("range_shown"))


@query(
    "frame_sizes",
    """SELECT p_partkey, p_size AS width, CAST(p_partkey AS INTEGER) AS height, round(p_retailprice, 2) AS start_s, round(p_retailprice, 2) + p_size AS end_s FROM part""",
)
def frame_sizes(spark, sf):
    size = text.resolution(F.concat_ws("x", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    price = F.round("p_retailprice", 2)
    span = text.segment(F.array(price.cast("string"), (price + F.col("p_size")).cast("string")))
    return fx.table(spark, sf, "part").select("p_partkey", size.alias("s"), span.alias("t")).select(
        "p_partkey", "s.width", "s.height", "t.start_s", "t.end_s"
    )


@query(
    "json_label_lists",
    f"""WITH {fx.TRAITS} SELECT {KEYS}, img_id, CAST(sum(y_true) AS BIGINT) AS n_true, CAST(sum(y_pred) AS BIGINT) AS n_pred FROM traits GROUP BY 1, 2, 3""",
)
def json_label_lists(spark, sf):
    rows = fx.traits(spark, sf)
    flags = F.transform("y_pred", lambda y: y == 1)
    rows = rows.select(*BY, "img_id", F.to_json("y_true").alias("t"), F.to_json(flags).alias("p"))

    def total(c):
        return F.aggregate(text.json_labels(F.col(c)), F.lit(0).cast("bigint"), lambda a, y: a + y)

    return rows.select(*BY, "img_id", total("t").alias("n_true"), total("p").alias("n_pred"))


@query("log_params", f"WITH {fx.DIMS} SELECT model_ckpt, round(log10(CAST(params AS DOUBLE)), 9) AS log_params FROM dims")
def log_params(spark, sf):
    return rounded(fx.dims(spark, sf).select("model_ckpt", text.log10_params(F.col("params")).alias("log_params")))


@query(
    "frame_count_votes",
    """WITH c AS (SELECT o_orderkey, o_orderkey % 200 + 900 AS a, o_orderkey % 200 + 900 + (o_orderkey % 7) * 3 AS b,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 50 + 950 END AS d FROM orders),
v AS (SELECT o_orderkey, 0 AS p, a AS v FROM c UNION ALL SELECT o_orderkey, 1, b FROM c UNION ALL SELECT o_orderkey, 2, d FROM c WHERE d IS NOT NULL),
s AS (SELECT x.o_orderkey, x.p, x.v,
  count(*) FILTER (WHERE y.v = x.v) * CASE WHEN bool_or(y.v <> x.v AND abs(x.v - y.v) <= 1e-2 * greatest(abs(x.v), abs(y.v))) THEN 2 ELSE 1 END AS votes
  FROM v x JOIN v y ON x.o_orderkey = y.o_orderkey GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY votes DESC, p) AS rn FROM s)
SELECT o_orderkey, CASE WHEN votes >= 2 THEN v END AS frames FROM r WHERE rn = 1""",
)
def frame_count_votes(spark, sf):
    key = F.col("o_orderkey")
    first = key % 200 + 900
    third = F.when(key % 5 != 0, F.col("o_custkey") % 50 + 950)
    candidates = F.array(first, first + (key % 7) * 3, third)
    return fx.table(spark, sf, "orders").select("o_orderkey", text.frame_count_vote(candidates).alias("frames"))


def _plain_sql(column: str) -> str:
    for char, plain in text.PLAIN_TEXT.items():
        column = f"replace({column}, '{char}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return column


@query(
    "plain_text",
    f"SELECT doc_id, md5({_plain_sql('text')}) AS digest, length({_plain_sql('text')}) AS n FROM documents",
)
def plain_text(spark, sf):
    fixed = text.plain_text(F.col("text"))
    docs = fx.table(spark, sf, "documents").select("doc_id", fixed.alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(
    "first_non_ascii",
    """SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN length(regexp_extract(text, '^([\\x00-\\x7F]*)', 1)) + 1 ELSE 0 END AS INTEGER) AS pos FROM documents""",
)
def first_non_ascii(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.first_non_ascii(F.col("text")).alias("pos"))


@query(
    "display_names",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building (B)' WHEN 'MACHINERY' THEN 'Machinery (M)' ELSE c_mktsegment END AS shown FROM customer",
)
def display_names(spark, sf):
    names = {"BUILDING": "Building (B)", "MACHINERY": "Machinery (M)"}
    return fx.table(spark, sf, "customer").select("c_custkey", text.renamed(F.col("c_mktsegment"), names).alias("shown"))


@query(
    "real_label_scores",
    """WITH p AS (SELECT 'docs' AS task_name, 'heuristic' AS model_ckpt, quality AS y_true, 1 - toxic AS y_pred FROM labels),
"""
    + F1_SQL.format(src="p")
    + """
SELECT task_name, model_ckpt, round(sum(2e0 * tp / total) / (max(label) + 1), 9) AS value FROM cls GROUP BY 1, 2""",
)
def real_label_scores(spark, sf):
    rows = fx.table(spark, sf, "labels").select(
        F.lit("docs").alias("task_name"),
        F.lit("heuristic").alias("model_ckpt"),
        F.col("quality").alias("y_true"),
        (1 - F.col("toxic")).alias("y_pred"),
    )
    return rounded(metrics.macro_f1(rows, BY))
