"""Sampling, bootstrap, significance and chance baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import fixtures as fx
from evalspark.catalog.registry import query, rounded
from evalspark.functions.draws import poisson_limits
from evalspark.operators import bootstrap as boot
from evalspark.operators import sampling
from evalspark.plans import report

SEED = 17
B = 500
ALPHA = 0.05


def sql_hash(*parts: str) -> str:
    """SQL of ``hash_long``."""
    return "('0x' || substr(md5(" + " || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15))::BIGINT"


def draws_sql(source: str, b: int = B) -> str:
    """SQL of the multinomial draw: ``w`` holds (task_name, img_id, replicate, w)."""
    return f"""
ex AS (SELECT task_name, img_id, row_number() OVER (PARTITION BY task_name ORDER BY img_id) - 1 AS p,
  count(*) OVER (PARTITION BY task_name) AS n FROM (SELECT DISTINCT task_name, img_id FROM {source})),
dr AS (SELECT task_name, replicate, {sql_hash(f"'{SEED}'", "task_name", "replicate", "p")} % n AS p
  FROM ex, (SELECT unnest(range({b})) AS replicate)),
w AS (SELECT ex.task_name, img_id, CAST(replicate AS INTEGER) AS replicate, count(*) AS w FROM dr JOIN ex ON ex.task_name = dr.task_name AND ex.p = dr.p GROUP BY 1, 2, 3)"""


def poisson_sql(source: str, b: int = B) -> str:
    """SQL of the Poisson draw."""
    steps = " ".join(f"WHEN h < {limit} THEN {k}" for k, limit in enumerate(poisson_limits()))
    return f"""
ex AS (SELECT DISTINCT task_name, img_id FROM {source}),
hs AS (SELECT task_name, img_id, CAST(replicate AS INTEGER) AS replicate, {sql_hash(f"'{SEED}'", "task_name", "replicate", "img_id")} AS h
  FROM ex, (SELECT unnest(range({b})) AS replicate)),
w AS (SELECT task_name, img_id, replicate, CASE {steps} ELSE {len(poisson_limits())} END AS w FROM hs)"""


HIT = "CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END"
MEAN_BOOT = f"""
bs AS (SELECT p.task_name, model_ckpt, replicate, sum(w * {HIT}) / sum(w) AS value
  FROM preds p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id GROUP BY 1, 2, 3)"""
F1_BOOT = f"""
cl AS (SELECT task_name, model_ckpt, replicate, label, sum(tp) AS tp, sum(c) AS total FROM (
  SELECT p.task_name, model_ckpt, replicate, y_true AS label, w AS c, w * {HIT} AS tp FROM preds p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id
  UNION ALL SELECT p.task_name, model_ckpt, replicate, y_pred, w, 0 FROM preds p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id
) GROUP BY 1, 2, 3, 4),
mx AS (SELECT task_name, model_ckpt, greatest(max(y_true), max(y_pred)) + 1 AS c FROM preds GROUP BY 1, 2),
bs AS (SELECT cl.task_name, cl.model_ckpt, replicate, sum(CASE WHEN total > 0 THEN 2e0 * tp / total END) / max(c) AS value
  FROM cl JOIN mx ON cl.task_name = mx.task_name AND cl.model_ckpt = mx.model_ckpt GROUP BY 1, 2, 3)"""
OUT = "SELECT task_name, model_ckpt, replicate, round(value, 9) AS value FROM bs"
CI = f"""ci AS (SELECT task_name, model_ckpt, avg(value) AS bootstrap_mean, quantile_cont(value, {ALPHA / 2}) AS ci_low, quantile_cont(value, {1 - ALPHA / 2}) AS ci_high FROM bs GROUP BY 1, 2)"""
TESTS = f"""
rv AS (SELECT task_name, model_ckpt, replicate, round(value, 12) AS value FROM bs),
mm AS (SELECT task_name, model_ckpt, round(avg(value), 12) AS m FROM bs GROUP BY 1, 2),
best AS (SELECT task_name, model_ckpt AS best FROM (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY m DESC, model_ckpt) AS r FROM mm) WHERE r = 1),
pv AS (SELECT a.task_name, a.model_ckpt, avg(CASE WHEN a.value >= t.value THEN 1e0 ELSE 0e0 END) AS p
  FROM rv a JOIN best USING (task_name) JOIN rv t ON t.task_name = a.task_name AND t.model_ckpt = best AND t.replicate = a.replicate GROUP BY 1, 2),
st AS (SELECT *, (count(*) OVER (PARTITION BY task_name) - row_number() OVER (PARTITION BY task_name ORDER BY p, model_ckpt) + 1) * p AS s FROM pv),
hm AS (SELECT task_name, model_ckpt, p, least(max(s) OVER (PARTITION BY task_name ORDER BY p, model_ckpt ROWS UNBOUNDED PRECEDING), 1e0) AS p_adj FROM st),
ties AS (SELECT task_name, string_agg(model_ckpt, ',' ORDER BY model_ckpt) AS ties FROM hm WHERE p_adj > {ALPHA} GROUP BY 1)"""


def boot_mean(spark, sf):
    return boot.bootstrap_mean(fx.predictions(spark, sf), B, SEED)


@query("bootstrap_mean", f"WITH {fx.PREDS}, {draws_sql('preds')}, {MEAN_BOOT} {OUT}")
def bootstrap_mean(spark, sf):
    return rounded(boot_mean(spark, sf))


@query("bootstrap_mean_poisson", f"WITH {fx.PREDS}, {poisson_sql('preds')}, {MEAN_BOOT} {OUT}")
def bootstrap_mean_poisson(spark, sf):
    return rounded(boot.bootstrap_mean(fx.predictions(spark, sf), B, SEED, "poisson"))


@query("bootstrap_accuracy", f"WITH {fx.PREDS}, {draws_sql('preds')}, {MEAN_BOOT} {OUT}")
def bootstrap_accuracy(spark, sf):
    return rounded(boot.bootstrap_accuracy(fx.predictions(spark, sf), B, SEED))


@query("bootstrap_macro_f1", f"WITH {fx.PREDS}, {draws_sql('preds')}, {F1_BOOT} {OUT}")
def bootstrap_macro_f1(spark, sf):
    return rounded(boot.bootstrap_macro_f1(fx.predictions(spark, sf), B, SEED))


@query("bootstrap_macro_f1_poisson", f"WITH {fx.PREDS}, {poisson_sql('preds')}, {F1_BOOT} {OUT}")
def bootstrap_macro_f1_poisson(spark, sf):
    return rounded(boot.bootstrap_macro_f1(fx.predictions(spark, sf), B, SEED, "poisson"))


@query(
    "bootstrap_macro_f1_averaged",
    f"""WITH {fx.PREDS}, {draws_sql("preds", 9 * B)}, {F1_BOOT}
SELECT task_name, model_ckpt, replicate // 9 AS replicate, round(avg(value), 9) AS value FROM bs GROUP BY 1, 2, 3""",
)
def bootstrap_macro_f1_averaged(spark, sf):
    return rounded(boot.bootstrap_macro_f1(fx.predictions(spark, sf), B, SEED, inner=9))


@query(
    "bootstrap_multilabel",
    f"""WITH {fx.TRAITS}, {draws_sql("traits")},
tc AS (SELECT task_name, model_ckpt, replicate, trait, label, sum(tp) AS tp, sum(c) AS total FROM (
  SELECT p.task_name, model_ckpt, replicate, trait, y_true AS label, w AS c, w * {HIT} AS tp FROM traits p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id
  UNION ALL SELECT p.task_name, model_ckpt, replicate, trait, y_pred, w, 0 FROM traits p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id
) GROUP BY 1, 2, 3, 4, 5),
tf AS (SELECT task_name, model_ckpt, replicate, trait, sum(2e0 * tp / total) / 2 AS v FROM tc GROUP BY 1, 2, 3, 4)
SELECT task_name, model_ckpt, replicate, round(avg(v), 9) AS value FROM tf GROUP BY 1, 2, 3""",
)
def bootstrap_multilabel(spark, sf):
    return rounded(boot.bootstrap_multilabel(fx.traits(spark, sf), B, SEED))


@query(
    "bootstrap_user_loss",
    f"""WITH {fx.UNKNOWN_PREDS}, {draws_sql("upreds")},
c AS (SELECT p.task_name, model_ckpt, replicate, CAST(sum(w) AS DOUBLE) AS n,
  sum(w * CASE WHEN y_true <> y_pred AND y_true <> -1 AND y_pred <> -1 THEN 1e0 WHEN y_true = -1 AND y_pred <> -1 THEN 1e1
    WHEN y_true <> -1 AND y_pred = -1 THEN 1e-1 ELSE 0e0 END) AS ce,
  sum(w * CASE WHEN y_true IN (1, 3) AND y_pred NOT IN (1, 3) THEN 1e2 WHEN y_true NOT IN (1, 3) AND y_pred IN (1, 3) THEN 1e0 ELSE 0e0 END) AS harm,
  sum(w * CASE WHEN y_true = -1 THEN 1 ELSE 0 END) AS u, sum(w * CASE WHEN y_true IN (1, 3) THEN 1 ELSE 0 END) AS h
  FROM upreds p JOIN w ON p.task_name = w.task_name AND p.img_id = w.img_id GROUP BY 1, 2, 3),
t AS (SELECT task_name, model_ckpt, sum(n) AS n, sum(u) AS u, sum(h) AS h FROM c GROUP BY 1, 2)
SELECT c.task_name, c.model_ckpt, replicate, round(1 - ((ce + harm) / c.n) / (9e0 * t.u / t.n + 1 + (1e2 * t.h + (t.n - t.h)) / t.n), 9) AS value
FROM c JOIN t ON c.task_name = t.task_name AND c.model_ckpt = t.model_ckpt""",
)
def bootstrap_user_loss(spark, sf):
    return rounded(boot.bootstrap_user_loss(fx.unknown_predictions(spark, sf), fx.HARMFUL, B, SEED))


@query(
    "confidence_intervals",
    f"""WITH {fx.PREDS}, {draws_sql("preds")}, {MEAN_BOOT}, {CI}
SELECT task_name, model_ckpt, round(bootstrap_mean, 9) AS bootstrap_mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM ci""",
)
def confidence_intervals(spark, sf):
    return rounded(boot.summarize_ci(boot_mean(spark, sf), ALPHA))


@query(
    "best_model_per_task",
    f"WITH {fx.PREDS}, {draws_sql('preds')}, {MEAN_BOOT}, {TESTS} SELECT task_name, best FROM best",
)
def best_model_per_task(spark, sf):
    return boot.best_model(boot_mean(spark, sf)).select("task_name", "best")


@query(
    "p_values_against_best",
    f"WITH {fx.PREDS}, {draws_sql('preds')}, {MEAN_BOOT}, {TESTS} SELECT task_name, model_ckpt, round(p, 9) AS p FROM pv",
)
def p_values_against_best(spark, sf):
    return rounded(boot.p_vs_best(boot_mean(spark, sf)))


@query(
    "holm_correction",
    f"""WITH {fx.PREDS}, {draws_sql("preds")}, {MEAN_BOOT}, {TESTS}
SELECT task_name, model_ckpt, round(p, 9) AS p, round(p_adj, 9) AS p_adj, p_adj <= {ALPHA} AS reject FROM hm""",
)
def holm_correction(spark, sf):
    return rounded(boot.holm(boot.p_vs_best(boot_mean(spark, sf)), ["task_name"], ALPHA))


@query(
    "best_and_ties",
    f"WITH {fx.PREDS}, {draws_sql('preds')}, {MEAN_BOOT}, {TESTS} SELECT task_name, best, ties FROM best JOIN ties USING (task_name)",
)
def best_and_ties(spark, sf):
    out = boot.best_and_ties(boot_mean(spark, sf), ALPHA)
    return out.withColumn("ties", F.array_join("ties", ","))


@query(
    "score_report",
    f"""WITH {fx.EXPERIMENTS}, known AS (SELECT * FROM preds WHERE model_ckpt <> 'm7'), {draws_sql("known")},
{F1_BOOT.replace("preds", "known")}, {CI}, {TESTS},
pt AS (SELECT cl.task_name, cl.model_ckpt, sum(2e0 * tp / total) / (max(label) + 1) AS mean FROM (
  SELECT task_name, model_ckpt, label, sum(tp) AS tp, count(*) AS total FROM (
    SELECT task_name, model_ckpt, y_true AS label, {HIT} AS tp FROM known UNION ALL SELECT task_name, model_ckpt, y_pred, 0 FROM known) GROUP BY 1, 2, 3) cl GROUP BY 1, 2)
SELECT ci.task_name AS task, ci.model_ckpt AS model, round(mean, 9) AS mean, round(bootstrap_mean, 9) AS bootstrap_mean,
round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, best, ties
FROM ci JOIN pt ON ci.task_name = pt.task_name AND ci.model_ckpt = pt.model_ckpt JOIN best ON best.task_name = ci.task_name JOIN ties ON ties.task_name = ci.task_name""",
)
def score_report(spark, sf):
    from evalspark.operators.tables import join_results

    joined = join_results(fx.experiments(spark, sf), fx.stored_predictions(spark, sf))
    rows = report.analysis_frame(joined)
    kinds = {"F": "macro_f1", "O": "macro_f1", "P": "macro_f1"}
    scores, bests = report.calc_scores(rows, B, ALPHA, SEED, task_scores=kinds)
    return rounded(scores.join(bests.withColumn("ties", F.array_join("ties", ",")), "task"))


@query(
    "score_report_mixed",
    f"""WITH {fx.PREDS}, t AS (SELECT CASE task_name WHEN 'F' THEN 'accuracy' WHEN 'O' THEN 'macro_f1' ELSE 'mean' END AS kind, * FROM preds),
f AS (SELECT model_ckpt, sum(2e0 * tp / total) / (max(label) + 1) AS v FROM (SELECT model_ckpt, label, sum(tp) AS tp, count(*) AS total FROM (
  SELECT model_ckpt, y_true AS label, {HIT} AS tp FROM preds WHERE task_name = 'O' UNION ALL SELECT model_ckpt, y_pred, 0 FROM preds WHERE task_name = 'O') GROUP BY 1, 2) GROUP BY 1)
SELECT task_name AS task, model_ckpt AS model, round(avg({HIT}), 9) AS mean FROM preds WHERE task_name <> 'O' GROUP BY 1, 2
UNION ALL SELECT 'O', model_ckpt, round(v, 9) FROM f""",
)
def score_report_mixed(spark, sf):
    kinds = {"F": "accuracy", "O": "macro_f1", "P": "mean"}
    rows = fx.predictions(spark, sf)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("y_true", "y_pred")})
    scores, _ = report.calc_scores(rows, 5, ALPHA, SEED, "poisson", kinds)
    return rounded(scores.select("task", "model", "mean"))


# ---- samples -------------------------------------------------------------


@query(
    "sample_rows",
    f"""SELECT o_orderkey, o_custkey FROM (SELECT *, {sql_hash("'17'", "'simple'", "o_orderkey")} AS h FROM orders)
QUALIFY row_number() OVER (ORDER BY h, o_orderkey) <= 500""",
)
def sample_rows(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.sample_n(orders, 500, SEED, "o_orderkey")


BALANCED = f"""
rk AS (SELECT doc_id, source, {sql_hash("'17'", "'row'", "doc_id")} AS h, row_number() OVER (PARTITION BY source ORDER BY {sql_hash("'17'", "'row'", "doc_id")}, doc_id) AS r FROM documents),
cs AS (SELECT source, n, row_number() OVER (ORDER BY {sql_hash("'17'", "'class'", "source")}, source) AS c, count(*) OVER () AS k FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
q AS (SELECT source, n, 503 // k + CASE WHEN c <= 503 % k THEN 1 ELSE 0 END AS quota FROM cs),
ins AS (SELECT doc_id, source FROM rk JOIN q USING (source) WHERE r <= quota),
rest AS (SELECT doc_id, source, row_number() OVER (ORDER BY h, doc_id) AS r FROM rk JOIN q USING (source) WHERE r > quota)
"""


@query(
    "balanced_sample",
    f"WITH {BALANCED} SELECT doc_id, source FROM ins UNION ALL SELECT doc_id, source FROM rest WHERE r <= 503 - (SELECT count(*) FROM ins)",
)
def balanced_sample(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.balanced_sample(docs, "source", 503, SEED, "doc_id")


@query(
    "stratified_sample",
    f"""WITH ev AS (SELECT event_id, event_type AS task, CAST(user_id % 2 AS INTEGER) AS label, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY {sql_hash("'17'", "'stratum'", "event_id")}, event_id) AS rn FROM ev WHERE split = 'train')
SELECT event_id, task, label, split FROM ev WHERE split <> 'train'
UNION ALL SELECT event_id, task, label, split FROM r WHERE rn <= CASE label WHEN 0 THEN 50 ELSE 51 END""",
)
def stratified_sample(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("task"),
        (F.col("user_id") % 2).cast("int").alias("label"),
        F.when(F.col("event_id") % 4 == 0, "test").otherwise("train").alias("split"),
    )
    return sampling.stratified_sample(rows, 101, SEED, "event_id")


@query(
    "temporal_split",
    """SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)
<= floor(8e-1 * count(*) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'val' END AS split FROM events""",
)
def temporal_split(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return sampling.temporal_split(rows, ["event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "chance_user_loss",
    f"""WITH tr AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS label, row_number() OVER (ORDER BY o_custkey % 20) AS p FROM orders WHERE o_orderstatus = 'F'),
te AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 20 = 0 THEN -1 ELSE o_custkey % 20 END AS INTEGER) AS y_true FROM orders WHERE o_orderstatus <> 'F'),
dr AS (SELECT trial, id, y_true, {sql_hash("'17'", "trial", "id")} % ((SELECT count(*) FROM tr) + 1) AS p FROM te, (SELECT unnest(range(1000)) AS trial)),
pr AS (SELECT trial, y_true, coalesce(label, -1) AS y_pred FROM dr LEFT JOIN tr ON tr.p = dr.p),
c AS (SELECT trial, count(*) AS n,
  sum(CASE WHEN y_true <> y_pred AND y_true <> -1 AND y_pred <> -1 THEN 1e0 WHEN y_true = -1 AND y_pred <> -1 THEN 1e1 WHEN y_true <> -1 AND y_pred = -1 THEN 1e-1 ELSE 0e0 END) AS ce,
  sum(CASE WHEN y_true IN (1, 3) AND y_pred NOT IN (1, 3) THEN 1e2 WHEN y_true NOT IN (1, 3) AND y_pred IN (1, 3) THEN 1e0 ELSE 0e0 END) AS harm,
  sum(CASE WHEN y_true = -1 THEN 1e0 ELSE 0e0 END) AS u, sum(CASE WHEN y_true IN (1, 3) THEN 1e0 ELSE 0e0 END) AS h FROM pr GROUP BY 1),
s AS (SELECT (1 - ((ce + harm) / n) / (9e0 * u / n + 1 + (1e2 * h + (n - h)) / n)) * 100 AS v FROM c)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM s""",
)
def chance_user_loss(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).cast("int").alias("label"), "o_orderstatus"
    )
    train = rows.where("o_orderstatus = 'F'")
    test = rows.where("o_orderstatus <> 'F'").select("id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("y_true"))
    return rounded(sampling.baseline_summary(sampling.chance_user_loss(test, train, 1000, SEED, "id", fx.HARMFUL)), 6)


@query(
    "chance_multilabel",
    f"""WITH bits AS (SELECT trial, j, CAST((o_custkey >> j) & 1 AS INTEGER) AS y_true, {sql_hash("'17'", "trial", "o_orderkey", "j")} % 2 AS y_pred
  FROM orders, (SELECT unnest(range(1000)) AS trial), (SELECT unnest(range(9)) AS j)),
c AS (SELECT trial, j, label, sum(tp) AS tp, count(*) AS total FROM (SELECT trial, j, y_true AS label, {HIT} AS tp FROM bits UNION ALL SELECT trial, j, y_pred, 0 FROM bits) GROUP BY 1, 2, 3),
f AS (SELECT trial, avg(v) * 100 AS v FROM (SELECT trial, j, sum(2e0 * tp / total) / 2 AS v FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM f""",
)
def chance_multilabel(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.array(*[(F.shiftright("o_custkey", j) % 2).cast("int") for j in range(9)]).alias("y_true")
    )
    return rounded(sampling.baseline_summary(sampling.chance_multilabel(rows, 9, 1000, SEED, "o_orderkey")), 6)
