"""Rank agreement, long-tail statistics and leaderboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import fixtures as fx
from evalspark.catalog.registry import query, rounded
from evalspark.catalog.resampling import ALPHA, MEAN_BOOT, TESTS, boot_mean, draws_sql, sql_hash
from evalspark.operators import longtail, metrics, rankstats
from evalspark.operators import bootstrap as boot
from evalspark.operators.tables import top_n
from evalspark.plans import leaderboard as board
from evalspark.scaling import group_rank

SEED = 17


def tau_sql(source: str, x: str, y: str, id_col: str, by: str = "'all'") -> str:
    """SQL of Kendall tau-b: (g, value)."""
    return f"""(SELECT a.g, sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(CAST(count(*) FILTER (WHERE a.x <> b.x) AS DOUBLE)) * sqrt(CAST(count(*) FILTER (WHERE a.y <> b.y) AS DOUBLE))) AS value
FROM (SELECT {by} AS g, {id_col} AS i, {x} AS x, {y} AS y FROM {source}) a JOIN (SELECT {by} AS g, {id_col} AS i, {x} AS x, {y} AS y FROM {source}) b ON a.g = b.g AND a.i < b.i GROUP BY 1)"""


def rho_sql(source: str, x: str, y: str, id_col: str, by: str = "'all'") -> str:
    """SQL of Spearman rho with ordinal ranks: (g, value)."""
    return f"""(SELECT g, corr(rx, ry) AS value FROM (SELECT {by} AS g, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {x}, {id_col}) AS DOUBLE) AS rx,
CAST(row_number() OVER (PARTITION BY {by} ORDER BY {y}, {id_col}) AS DOUBLE) AS ry FROM {source}) GROUP BY 1)"""


@query(
    "ordinal_rank",
    "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS rank FROM customer",
)
def ordinal_rank(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rankstats.ordinal_rank(rows, ["c_mktsegment"], "c_acctbal", "c_custkey", "rank").drop("c_acctbal")


@query(
    "pearson",
    f"WITH {fx.WIDE} SELECT round(corr(\"A\", mean), 9) AS value FROM complete",
)
def pearson(spark, sf):
    return rounded(rankstats.pearson(fx.complete(spark, sf), [], "A", "mean"))


@query("spearman", f"WITH {fx.WIDE} SELECT round(value, 9) AS value FROM {rho_sql('complete', chr(34) + 'A' + chr(34), 'mean', 'model')}")
def spearman(spark, sf):
    return rounded(rankstats.spearman(fx.complete(spark, sf), [], "A", "mean", "model"))


@query(
    "spearman_average_ties",
    """WITH r AS (SELECT l_returnflag, l_quantity, l_discount, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS rx,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2e0 AS ry FROM lineitem)
SELECT l_returnflag, round(corr(rx, ry), 9) AS value FROM r GROUP BY 1""",
)
def spearman_average_ties(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", "l_discount",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
    )
    out = rankstats.spearman(rows, ["l_returnflag"], "l_quantity", "l_discount", "id", ties="average")
    return rounded(out)


@query("kendall", f"WITH {fx.WIDE} SELECT round(value, 9) AS value FROM {tau_sql('complete', chr(34) + 'A' + chr(34), 'mean', 'model')}")
def kendall(spark, sf):
    return rounded(rankstats.kendall_tau(fx.complete(spark, sf), [], "A", "mean", "model"))


@query(
    "kendall_with_ties",
    "SELECT g AS label, round(value, 9) AS value FROM " + tau_sql("customer", "c_nationkey", "round(c_acctbal, -2)", "c_custkey", "c_mktsegment"),
)
def kendall_with_ties(spark, sf):
    rows = fx.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("label"), "c_custkey", "c_nationkey", F.round("c_acctbal", -2).alias("balance")
    )
    return rounded(rankstats.kendall_tau(rows, ["label"], "c_nationkey", "balance", "c_custkey"))


@query(
    "kendall_embedding_dims",
    "SELECT round(value, 9) AS value FROM " + tau_sql("embeddings", "embedding[1]", "embedding[2]", "vec_id"),
)
def kendall_embedding_dims(spark, sf):
    rows = fx.embeddings(spark, sf).select("id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return rounded(rankstats.kendall_tau(rows, [], "x", "y", "id"))


def resampled_sql(source: str, group: str, b: int) -> str:
    """SQL of ``resampled``: rs has (g, replicate, slot, x, y)."""
    return f"""
ps AS (SELECT {group} AS g, model, x, y, row_number() OVER (PARTITION BY {group} ORDER BY model) - 1 AS p, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
rs AS (SELECT s.g, replicate, s.p AS slot, t.x, t.y, CAST(s.g AS VARCHAR) || '-' || replicate AS gr FROM ps s, (SELECT unnest(range({b})) AS replicate) JOIN ps t
  ON t.g = s.g AND t.p = {sql_hash("'17'", "s.g", "replicate", "s.p")} % s.n)"""


@query(
    "bootstrap_kendall",
    f"""WITH {fx.WIDE}, src AS (SELECT 0 AS g, model, "A" AS x, mean AS y FROM complete), {resampled_sql("src", "g", 5000)},
t AS (SELECT value FROM {tau_sql("rs", "x", "y", "slot", "gr")})
SELECT round(quantile_cont(value, 25e-3), 9) AS ci_low, round(quantile_cont(value, 975e-3), 9) AS ci_high FROM t""",
)
def bootstrap_kendall(spark, sf):
    reps = rankstats.bootstrap_rank(fx.complete(spark, sf), [], "A", "mean", "model", 5000, SEED)
    return rounded(rankstats.percentile_band(reps, []))


@query(
    "bootstrap_spearman",
    f"""WITH {fx.WIDE}, src AS (SELECT 0 AS g, model, "A" AS x, mean AS y FROM complete), {resampled_sql("src", "g", 5000)}
SELECT CAST(split_part(g, '-', 2) AS INTEGER) AS replicate, round(value, 9) AS value FROM {rho_sql("rs", "x", "y", "slot", "gr")}""",
)
def bootstrap_spearman(spark, sf):
    return rounded(rankstats.bootstrap_rank(fx.complete(spark, sf), [], "A", "mean", "model", 5000, SEED, "rho"))


@query(
    "permutation_p_value",
    f"""WITH {fx.WIDE}, sh AS (SELECT replicate, x, y FROM (SELECT replicate, "A" AS x, row_number() OVER (PARTITION BY replicate ORDER BY {sql_hash("'17'", "replicate", "model")}, model) AS p FROM complete, (SELECT unnest(range(5000)) AS replicate))
JOIN (SELECT mean AS y, row_number() OVER (ORDER BY model) AS p FROM complete) USING (p)),
sn AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY y, x) AS i FROM sh),
st AS (SELECT value FROM {tau_sql("sn", "x", "y", "i", "replicate")}), ob AS (SELECT value FROM {tau_sql("complete", chr(34) + "A" + chr(34), "mean", "model")})
SELECT round((count(*) FILTER (WHERE round(st.value, 12) >= (SELECT round(value, 12) FROM ob)) + 1) / (count(*) + 1e0), 9) AS p FROM st""",
)
def permutation_p_value(spark, sf):
    return rounded(rankstats.permutation_p(fx.complete(spark, sf), "A", "mean", "model", 5000, SEED))


AGREE = f"""WITH {fx.WIDE}, top AS (SELECT * FROM complete ORDER BY mean DESC, model LIMIT {{n}}),
lg AS (SELECT model, mean, task, score FROM top UNPIVOT (score FOR task IN ("A", "N", "R")))"""


@query("internal_agreement_tau", AGREE.format(n=50) + f" SELECT round(avg(value), 9) AS value FROM {tau_sql('lg', 'mean', 'score', 'model', 'task')}")
def internal_agreement_tau(spark, sf):
    return rounded(rankstats.internal_agreement(fx.complete(spark, sf), "model", fx.TASKS, 50))


@query("internal_agreement_rho", AGREE.format(n=10) + f" SELECT round(avg(value), 9) AS value FROM {rho_sql('lg', 'mean', 'score', 'model', 'task')}")
def internal_agreement_rho(spark, sf):
    return rounded(rankstats.internal_agreement(fx.complete(spark, sf), "model", fx.TASKS, 10, "rho"))


THRESHOLDS = [0.0, 0.0475, 0.049, 0.05, 0.0505, 0.055]
SWEPT = f"""WITH {fx.WIDE}, rows AS (SELECT threshold, model, "A" AS x, mean AS y FROM complete, (SELECT unnest({[f"{t:g}" for t in THRESHOLDS]})::DOUBLE AS threshold) WHERE "A" >= threshold),
kept AS (SELECT threshold, count(*) AS n_models FROM rows GROUP BY 1 HAVING count(*) >= 10), src AS (SELECT rows.* FROM rows JOIN kept USING (threshold))"""


@query("threshold_sweep", SWEPT + " SELECT threshold, n_models FROM kept")
def threshold_sweep(spark, sf):
    rows = rankstats.threshold_sweep(fx.complete(spark, sf), "A", THRESHOLDS, 10)
    return rows.select("threshold", "n_models").distinct()


@query(
    "hook_curve",
    SWEPT
    + f""", {resampled_sql("src", "threshold", 500)}, t AS (SELECT value, CAST(split_part(g, '-', 1) AS DOUBLE) AS threshold FROM {tau_sql("rs", "x", "y", "slot", "gr")}),
pt AS (SELECT g AS threshold, value FROM {tau_sql("src", "x", "y", "model", "threshold")})
SELECT threshold, round(max(pt.value), 9) AS tau, round(quantile_cont(t.value, 25e-3), 9) AS ci_low, round(quantile_cont(t.value, 975e-3), 9) AS ci_high FROM t JOIN pt USING (threshold) GROUP BY 1""",
)
def hook_curve(spark, sf):
    return rounded(rankstats.hook_curve(fx.complete(spark, sf), "A", "mean", "model", THRESHOLDS, 10, 500, SEED))


# ---- long tail -----------------------------------------------------------

PARTS = "c AS (SELECT l_returnflag AS g, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def part_counts(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_partkey")
    return longtail.class_counts(rows, ["g"], "l_partkey")


def tail(name, fn, sql, digits=9):
    """Register a statistic of line items per part and return flag."""

    @query(name, f"WITH {PARTS} {sql}")
    def run(spark, sf):
        return rounded(fn(part_counts(spark, sf), ["g"]), digits)

    return run


tail(
    "zipf_exponent",
    longtail.zipf_exponent,
    "SELECT g, round(-regr_slope(ln(n), ln(r)), 9) AS value FROM (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n DESC) AS r FROM c) GROUP BY 1",
)
tail(
    "effective_classes",
    longtail.effective_classes,
    "SELECT g, round(exp(-sum(p * ln(p))), 6) AS value FROM (SELECT g, n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS p FROM c) GROUP BY 1",
    digits=6,
)
tail("imbalance_ratio", longtail.imbalance_ratio, "SELECT g, round(max(n) / CAST(min(n) AS DOUBLE), 9) AS value FROM c GROUP BY 1")
tail(
    "gini",
    longtail.gini,
    """SELECT g, round(1 - 2 * sum(cum / tot) / (count(*) + 1), 9) AS value FROM (SELECT g, CAST(sum(n) OVER (PARTITION BY g ORDER BY n, l_partkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum,
CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS tot FROM c) GROUP BY 1""",
)
tail(
    "tail_mass",
    longtail.tail_mass,
    """SELECT g, round(min(r) FILTER (WHERE cum >= 9e-1 * tot) / CAST(max(r) AS DOUBLE), 9) AS value FROM (SELECT g, row_number() OVER (PARTITION BY g ORDER BY n DESC, l_partkey) AS r,
sum(n) OVER (PARTITION BY g ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY g) AS tot FROM c) GROUP BY 1""",
)


@query(
    "linear_fit",
    """SELECT event_type, round(regr_slope(value, user_id), 9) AS slope, round(regr_intercept(value, user_id), 9) AS intercept, round(regr_r2(value, user_id), 9) AS r2,
CAST(min(user_id) AS DOUBLE) AS x_min, CAST(max(user_id) AS DOUBLE) AS x_max, count(*) AS n FROM events GROUP BY 1""",
)
def linear_fit(spark, sf):
    return rounded(rankstats.linear_fit(fx.table(spark, sf, "events"), ["event_type"], "user_id", "value"))


# ---- leaderboard ---------------------------------------------------------


@query("pivot_scores", f'WITH {fx.WIDE} SELECT model, "A", "N", "R" FROM wide')
def pivot_scores(spark, sf):
    return board.pivot_scores(fx.scores(spark, sf), fx.TASKS)


def sparse_scores(spark, sf):
    """Scores without the ones of some suppliers on task N."""
    rows = fx.scores(spark, sf)
    return rows.where(~((F.col("task") == "N") & F.col("model").endswith("7")))


SPARSE = f"WITH {fx.SCORES}, sparse AS (SELECT * FROM scores WHERE NOT (task = 'N' AND model LIKE '%7'))"


@query(
    "complete_case_mean",
    SPARSE + " SELECT model, CASE WHEN count(*) FILTER (WHERE task IN ('A', 'N')) = 2 THEN round(avg(mean) FILTER (WHERE task IN ('A', 'N')), 12) END AS mean FROM sparse GROUP BY 1",
)
def complete_case_mean(spark, sf):
    return rounded(board.complete_mean(sparse_scores(spark, sf), ["A", "N"]), 12)


BOARD = (
    SPARSE
    + """, board AS (SELECT model, max(CASE WHEN task = 'A' THEN mean END) AS "A", max(CASE WHEN task = 'N' THEN mean END) AS "N", max(CASE WHEN task = 'R' THEN mean END) AS "R",
CASE WHEN count(*) = 3 THEN avg(mean) END AS mean FROM sparse GROUP BY 1)"""
)


@query("leaderboard", BOARD + ' SELECT model, "A", "N", "R", round(mean, 9) AS mean FROM board')
def leaderboard(spark, sf):
    return rounded(board.leaderboard(sparse_scores(spark, sf), fx.TASKS))


@query(
    "leaderboard_sorted",
    BOARD + " SELECT model, round(mean, 9) AS mean, row_number() OVER (ORDER BY round(mean, 9) DESC NULLS LAST, model DESC) AS place FROM board",
)
def leaderboard_sorted(spark, sf):
    wide = rounded(board.leaderboard(sparse_scores(spark, sf), fx.TASKS)).select("model", "mean")
    return group_rank(wide, [], board.sort_keys("mean", "model"), "place")


@query(
    "leaderboard_sorted_by_text",
    f"WITH {fx.DIMS}, n AS (SELECT model_ckpt, CASE WHEN family = 'f1' THEN NULL ELSE family END AS family FROM dims) SELECT model_ckpt, family, row_number() OVER (ORDER BY family ASC NULLS LAST, model_ckpt) AS place FROM n",
)
def leaderboard_sorted_by_text(spark, sf):
    rows = fx.dims(spark, sf).select("model_ckpt", F.when(F.col("family") != "f1", F.col("family")).alias("family"))
    return group_rank(rows, [], board.sort_keys("family", "model_ckpt", numeric=False, descending=False), "place")


RANGES = [(0, 50_000_000), (50_000_000, 100_000_000), (1_000_000_000, 2_000_000_000)]


@query(
    "filter_models",
    f"""WITH {fx.DIMS} SELECT * FROM dims WHERE family IN ('f0', 'f2') AND resolution IN (224, 384)
AND ((params > 0 AND params < 50000000) OR (params > 50000000 AND params < 100000000) OR (params > 1000000000 AND params < 2000000000))""",
)
def filter_models(spark, sf):
    return board.filter_models(fx.dims(spark, sf), ["f0", "f2"], [224, 384], RANGES)


@query("select_tasks", f'WITH {fx.WIDE} SELECT model, "R" FROM wide')
def select_tasks(spark, sf):
    return board.select_tasks(board.pivot_scores(fx.scores(spark, sf), fx.TASKS), ["R"], ["model"])


@query(
    "top_models",
    f"WITH {fx.WIDE} SELECT model, round(mean, 9) AS mean FROM complete ORDER BY mean DESC, model LIMIT 10",
)
def top_models(spark, sf):
    return rounded(top_n(fx.complete(spark, sf).select("model", "mean"), F.col("mean"), 10, "model"))


@query(
    "winner_marks",
    f"""WITH {fx.PREDS}, {draws_sql("preds")}, {MEAN_BOOT}, {TESTS},
won AS (SELECT model_ckpt, string_agg(task_name, ',' ORDER BY task_name) AS winners FROM hm WHERE p_adj > {ALPHA} GROUP BY 1)
SELECT m.model_ckpt AS model, coalesce(winners, '') AS winners FROM (SELECT DISTINCT model_ckpt FROM preds) m LEFT JOIN won ON won.model_ckpt = m.model_ckpt""",
)
def winner_marks(spark, sf):
    bests = boot.best_and_ties(boot_mean(spark, sf), ALPHA).withColumnRenamed("task_name", "task")
    means = metrics.mean_score(fx.predictions(spark, sf), ["task_name", "model_ckpt"])
    scores = means.toDF("task", "model", "mean")
    marked = board.with_winners(board.pivot_scores(scores, ["F", "O", "P"]), bests)
    return marked.select("model", F.array_join("winners", ",").alias("winners"))


@query(
    "score_trend",
    f"""WITH {fx.WIDE}, lg AS (SELECT "A" AS x, task, score FROM wide UNPIVOT (score FOR task IN ("N", "R")) WHERE "A" IS NOT NULL)
SELECT task, round(regr_slope(score * 100, x * 100), 9) AS slope, round(regr_intercept(score * 100, x * 100), 9) AS intercept, round(regr_r2(score * 100, x * 100), 9) AS r2,
round(min(x * 100), 9) AS x_min, round(max(x * 100), 9) AS x_max, count(*) AS n FROM lg GROUP BY 1""",
)
def score_trend(spark, sf):
    wide = board.pivot_scores(fx.scores(spark, sf), fx.TASKS)
    return rounded(board.score_trend(wide, "A", ["N", "R"]))


PARAMS_FIT = f"""WITH {fx.SCORES}, {fx.DIMS}, j AS (SELECT task, log10(CAST(params AS DOUBLE)) AS x, mean * 100 AS y FROM scores JOIN dims ON model = model_ckpt),
fit AS (SELECT task, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, min(x) AS x_min, max(x) AS x_max, count(*) AS n FROM j GROUP BY 1)"""


@query(
    "params_trend",
    PARAMS_FIT + " SELECT task, round(slope, 9) AS slope, round(intercept, 9) AS intercept, round(r2, 9) AS r2, round(x_min, 9) AS x_min, round(x_max, 9) AS x_max, n FROM fit",
)
def params_trend(spark, sf):
    return rounded(board.params_trend(fx.scores(spark, sf), fx.dims(spark, sf)))


@query(
    "trend_line_points",
    PARAMS_FIT + " SELECT task, round(x, 9) AS x, round(slope * x + intercept, 9) AS y FROM (SELECT task, slope, intercept, unnest([x_min, x_max]) AS x FROM fit)",
)
def trend_line_points(spark, sf):
    return rounded(board.line_points(board.params_trend(fx.scores(spark, sf), fx.dims(spark, sf))))


@query(
    "complete_matrix",
    f"""WITH {fx.WIDE}, {fx.DIMS} SELECT model, "A", "N", "R", round(mean, 9) AS mean FROM complete JOIN dims ON model = model_ckpt WHERE family <> 'f1'""",
)
def complete_matrix(spark, sf):
    return rounded(board.complete_matrix(fx.scores(spark, sf), fx.TASKS, fx.dims(spark, sf), ["f1"]))


@query(
    "bar_series",
    f"WITH {fx.SCORES}, {fx.DIMS} SELECT task, model, family, mean AS score FROM scores JOIN dims ON model = model_ckpt WHERE mean IS NOT NULL",
)
def bar_series(spark, sf):
    return rounded(board.bar_series(fx.scores(spark, sf), fx.dims(spark, sf)))


CELL = "CASE WHEN {x} IS NULL THEN '' ELSE printf('%.1f', round({x} * 100, 1)) END"


@query(
    "text_table",
    BOARD
    + f""" SELECT model, model || ' ' || {CELL.format(x='"A"')} || ' & ' || {CELL.format(x='"N"')} || ' & ' || {CELL.format(x='"R"')} || ' & ' || {CELL.format(x="mean")} AS line FROM board""",
)
def text_table(spark, sf):
    return board.text_table(sparse_scores(spark, sf), fx.TASKS, fx.TASKS, min_tasks=3)
