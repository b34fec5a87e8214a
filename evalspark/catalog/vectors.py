"""Vector functions, pooling, neighbours, centroids, open-set detection and probes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evalspark.catalog import fixtures as fx
from evalspark.catalog.registry import query, rounded
from evalspark.catalog.resampling import sql_hash
from evalspark.functions import text, vectors
from evalspark.functions.draws import hash_long
from evalspark.operators import centroid, encoders, kernels, metrics, neighbours, openset, probes
from evalspark.operators.tables import balanced_weights, flag_ood
from evalspark.plans.probe import run_probe, simpleshot

ELEMS = f"WITH {fx.UNIT_VECTORS}"
CENTRED = """,
mu AS (SELECT j, avg(x) AS m FROM elems GROUP BY 1),
cen AS (SELECT vec_id, label, j, x - m AS x FROM elems JOIN mu USING (j)),
len AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM cen GROUP BY 1),
unit AS (SELECT cen.vec_id, label, j, x / n AS x FROM cen JOIN len ON cen.vec_id = len.vec_id)"""
SHOT = """,
shot AS (SELECT label, j, avg(x) AS x FROM unit GROUP BY 1, 2),
near AS (SELECT u.vec_id, u.label AS y_true, s.label AS y_pred, sum((u.x - s.x) * (u.x - s.x)) AS d2 FROM unit u JOIN shot s ON u.j = s.j GROUP BY 1, 2, 3),
pick AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 12), y_pred) = 1)"""


def long(df, *keys, col="embedding"):
    """Vector elements as rows, numbered from 1."""
    return df.select(*keys, F.posexplode(col).alias("pos", "value")).select(
        *keys, (F.col("pos") + 1).alias("j"), F.round("value", 9).alias("value")
    )


@query(
    "l2_normalize",
    ELEMS + ", n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM elems GROUP BY 1) SELECT elems.vec_id AS id, CAST(j AS INTEGER) AS j, round(x / n, 9) AS value FROM elems JOIN n ON elems.vec_id = n.vec_id",
)
def l2_normalize(spark, sf):
    return long(vectors.l2_normalize(fx.embeddings(spark, sf), "embedding"), "id")


@query("center_and_normalize", ELEMS + CENTRED + " SELECT vec_id AS id, CAST(j AS INTEGER) AS j, round(x, 9) AS value FROM unit")
def center_and_normalize(spark, sf):
    rows = fx.embeddings(spark, sf)
    return long(vectors.center_and_normalize(rows, "embedding", vectors.fit_center(rows, "embedding")), "id")


@query("center_vectors", ELEMS + CENTRED + " SELECT vec_id AS id, CAST(j AS INTEGER) AS j, round(x, 9) AS value FROM cen")
def center_vectors(spark, sf):
    rows = fx.embeddings(spark, sf)
    return long(vectors.center(rows, "embedding", vectors.fit_center(rows, "embedding")), "id")


@query(
    "layer_norm",
    ELEMS + ", s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM elems GROUP BY 1) SELECT elems.vec_id AS id, CAST(j AS INTEGER) AS j, round((x - m) / sqrt(v + 1e-5), 9) AS value FROM elems JOIN s ON elems.vec_id = s.vec_id",
)
def layer_norm(spark, sf):
    rows = fx.embeddings(spark, sf)
    return long(rows.withColumn("embedding", vectors.layer_norm(F.col("embedding"))), "id")


PATCHES = ELEMS + ", pt AS (SELECT vec_id, (j - 1) // 8 AS p, (j - 1) % 8 + 1 AS d, x FROM elems)"


def patch_rows(spark, sf):
    """Each vector of 64 as 8 patches of 8."""
    wide = F.col("embedding").cast("array<double>")
    patches = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(wide, i * 8 + 1, 8))
    return fx.embeddings(spark, sf).select("id", patches.alias("patches"))


@query(
    "patch_pooling",
    PATCHES
    + """, r AS (SELECT vec_id, d, (d + 0) AS j, p % 4 AS q, avg(x) AS m FROM pt GROUP BY 1, 2, 4)
SELECT f.vec_id AS id, CAST(f.d AS INTEGER) AS j, round(f.first, 9) AS first, round(f.mx, 9) AS mx, round(f.mean, 9) AS mean, round(r2.m, 9) AS mean_max
FROM (SELECT vec_id, d, max(CASE WHEN p = 0 THEN x END) AS first, max(x) AS mx, avg(x) AS mean FROM pt GROUP BY 1, 2) f
JOIN (SELECT vec_id, d, max(m) AS m FROM r GROUP BY 1, 2) r2 ON f.vec_id = r2.vec_id AND f.d = r2.d""",
)
def patch_pooling(spark, sf):
    rows = patch_rows(spark, sf)
    pooled = rows.select(
        "id",
        F.posexplode(
            F.arrays_zip(
                vectors.first_token(F.col("patches")).alias("first"),
                vectors.max_patch(F.col("patches")).alias("mx"),
                vectors.mean_patch(F.col("patches")).alias("mean"),
                vectors.mean_then_max(F.col("patches"), 2).alias("mean_max"),
            )
        ).alias("pos", "v"),
    )
    return rounded(pooled.select("id", (F.col("pos") + 1).alias("j"), "v.first", "v.mx", "v.mean", "v.mean_max"))


@query(
    "pool_observations",
    ELEMS
    + """, o AS (SELECT vec_id // 5 AS obs, j, avg(x) AS x FROM elems GROUP BY 1, 2), l AS (SELECT vec_id // 5 AS obs, min_by(label, vec_id) AS label FROM embeddings GROUP BY 1)
SELECT o.obs, label, CAST(j AS INTEGER) AS j, round(x, 9) AS value FROM o JOIN l ON o.obs = l.obs""",
)
def pool_observations(spark, sf):
    rows = fx.embeddings(spark, sf).withColumn("obs", F.expr("id div 5"))
    return long(centroid.pool_observations(rows, "obs", "embedding", "label", "id"), "obs", "label")


@query(
    "pool_frames_max",
    ELEMS + " SELECT vec_id // 5 AS clip, CAST(j AS INTEGER) AS j, round(max(x), 9) AS value FROM elems GROUP BY 1, 2",
)
def pool_frames_max(spark, sf):
    rows = fx.embeddings(spark, sf).withColumn("clip", F.expr("id div 5"))
    return long(vectors.pool_max(rows, ["clip"], "embedding"), "clip")


@query(
    "column_moments",
    ELEMS + " SELECT CAST(j AS INTEGER) AS j, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM elems GROUP BY 1",
)
def column_moments(spark, sf):
    out = vectors.column_moments(fx.embeddings(spark, sf), "embedding")
    pairs = F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "v")
    return rounded(out.select("n", pairs).select((F.col("pos") + 1).alias("j"), "n", "v.mean", "v.std"))


@query(
    "class_moments",
    ELEMS + " SELECT label, CAST(j AS INTEGER) AS j, count(*) AS n, round(avg(x), 9) AS mean, round(var_pop(x), 9) AS variance FROM elems GROUP BY 1, 2",
)
def class_moments(spark, sf):
    out = openset.class_moments(fx.embeddings(spark, sf), "embedding", "label")
    pairs = F.posexplode(F.arrays_zip("mean", "variance")).alias("pos", "v")
    return rounded(out.select("label", "n", pairs).select("label", (F.col("pos") + 1).alias("j"), "n", "v.mean", "v.variance"))


@query(
    "simpleshot_centroids",
    ELEMS + CENTRED + SHOT + " SELECT label, CAST(j AS INTEGER) AS j, round(x, 9) AS value FROM shot",
)
def simpleshot_centroids(spark, sf):
    return long(centroid.simpleshot_fit(fx.embeddings(spark, sf)).centroids, "label")


@query(
    "simpleshot_predict",
    ELEMS + CENTRED + SHOT + " SELECT vec_id AS id, y_true AS label, y_pred, round(sqrt(d2), 6) AS dist FROM pick",
)
def simpleshot_predict(spark, sf):
    rows = fx.embeddings(spark, sf)
    return rounded(centroid.simpleshot_fit(rows).predict(rows).select("id", "label", "y_pred", "dist"), 6)


NEIGHBOURS = """,
pr AS (SELECT a.vec_id AS qid, b.vec_id AS rid, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM elems a JOIN elems b ON a.j = b.j AND a.vec_id <> b.vec_id GROUP BY 1, 2),
nn AS (SELECT qid, rid, sqrt(d2) AS dist, row_number() OVER (PARTITION BY qid ORDER BY sqrt(d2), rid) AS rank FROM pr QUALIFY rank <= 5)"""


@query(
    "nearest_neighbours",
    ELEMS + NEIGHBOURS + " SELECT qid, rid, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM nn",
)
def nearest_neighbours(spark, sf):
    rows = fx.embeddings(spark, sf)
    return rounded(neighbours.knn_join(rows, rows, 5, exclude_self=True), 6)


@query(
    "neighbour_vote",
    ELEMS
    + NEIGHBOURS
    + """, v AS (SELECT qid, label, count(*) AS n FROM nn JOIN embeddings ON rid = vec_id GROUP BY 1, 2),
b AS (SELECT qid, label FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1)
SELECT qid AS id, e.label AS y_true, b.label AS y_pred FROM b JOIN embeddings e ON e.vec_id = qid""",
)
def neighbour_vote(spark, sf):
    return neighbours.knn_vote(fx.embeddings(spark, sf))


DIAG = """,
cm AS (SELECT label, j, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM elems GROUP BY 1, 2),
pv AS (SELECT j, sum(v * n) / sum(n) AS v FROM cm GROUP BY 1),
dd AS (SELECT e.vec_id, e.label AS y, cm.label, sum((e.x - cm.m) * (e.x - cm.m) / pv.v) AS d2 FROM elems e JOIN cm ON e.j = cm.j JOIN pv ON e.j = pv.j GROUP BY 1, 2, 3),
dm AS (SELECT vec_id, y, label AS near, d2 FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) = 1)"""


def diagonal_precision(rows):
    """Inverse of the pooled within-class variance per dimension, as a matrix of model size."""
    moments = openset.class_moments(rows, "embedding", "label")
    variance = openset.pooled_variance(moments).first()["variance"]
    return moments, np.diag(1 / np.asarray(variance))


@query(
    "mahalanobis_diagonal",
    ELEMS + DIAG + " SELECT vec_id AS id, near, round(d2, 6) AS d2 FROM dm",
)
def mahalanobis_diagonal(spark, sf):
    rows = fx.embeddings(spark, sf)
    moments, precision = diagonal_precision(rows)
    out = openset.min_mahalanobis(rows, moments, precision, diagonal=True)
    return rounded(out.select("id", "near", "d2"), 6)


@query(
    "openset_threshold_diagonal",
    ELEMS + DIAG + ", t AS (SELECT quantile_cont(d2, 95e-2) AS t FROM dm) SELECT vec_id AS id, (SELECT t FROM t) - d2 >= 0 AS known FROM dm",
)
def openset_threshold_diagonal(spark, sf):
    rows = fx.embeddings(spark, sf)
    moments, precision = diagonal_precision(rows)
    scored = openset.min_mahalanobis(rows, moments, precision, diagonal=True)
    threshold = scored.agg(F.percentile("d2", F.lit(0.95)).alias("t")).scalar()
    return scored.select("id", (threshold - F.col("d2") >= 0).alias("known"))


# Ledoit-Wolf shrinkage of each class on standardised features, pooled by the classes' shares of rows.
SHRUNK = """,
cm AS (SELECT label, j, count(*) AS n, avg(x) AS m, CASE WHEN var_pop(x) > 0 THEN sqrt(var_pop(x)) ELSE 1e0 END AS sd FROM elems GROUP BY 1, 2),
z AS (SELECT vec_id, e.label, e.j, (x - m) / sd AS z FROM elems e JOIN cm ON e.label = cm.label AND e.j = cm.j),
s AS (SELECT a.label, a.j AS i, b.j, sum(a.z * b.z) AS p, count(*) AS n FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3),
q AS (SELECT label, sum(l * l) AS fourth FROM (SELECT vec_id, label, sum(z * z) AS l FROM z GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT label, max(n) AS n, sqrt(count(*)) AS d, sum(p * p) / max(n) / max(n) AS fro, sum(CASE WHEN i = j THEN p ELSE 0 END) / max(n) AS tr FROM s GROUP BY 1),
u AS (SELECT t.label, n, tr / d AS mu, (fro - 2 * tr / d * tr + tr * tr / d) / d AS spread, (fourth / n - fro) / (n * d) AS noise FROM t JOIN q ON t.label = q.label),
w AS (SELECT label, n / (SELECT sum(n) FROM u) AS share, n, mu, CASE WHEN spread = 0 THEN 0e0 ELSE least(noise, spread) / spread END AS k FROM u)
SELECT CAST(s.i - 1 AS INTEGER) AS i, CAST(s.j - 1 AS INTEGER) AS j,
  round(sum(share * ((1 - k) * p / w.n + CASE WHEN s.i = s.j THEN k * mu ELSE 0 END) * a.sd * b.sd), 9) AS v
FROM s JOIN w ON s.label = w.label JOIN cm a ON a.label = s.label AND a.j = s.i JOIN cm b ON b.label = s.label AND b.j = s.j WHERE s.i <= s.j GROUP BY 1, 2"""


@query("pooled_covariance_shrunk", ELEMS + SHRUNK)
def pooled_covariance_shrunk(spark, sf):
    rows = fx.embeddings(spark, sf)
    moments = openset.class_moments(rows, "embedding", "label")
    found = openset.pooled_covariance(rows, moments, "embedding", "label", "id")
    i, j = np.triu_indices(len(found))
    cells = [(int(a), int(b), float(found[a, b])) for a, b in zip(i, j, strict=True)]
    return rounded(spark.createDataFrame(cells, "i int, j int, v double"))


# Without shrinkage the squared distances to the own class's mean add up to rows times dimensions.
@query(
    "mahalanobis_full_law",
    "SELECT count(*) AS n, CAST(count(*) * max(len(embedding)) AS DOUBLE) AS total, true AS nearest_is_least FROM embeddings",
)
def mahalanobis_full_law(spark, sf):
    rows = fx.embeddings(spark, sf)
    moments = openset.class_moments(rows, "embedding", "label")
    precision = openset.precision_of(openset.pooled_covariance(rows, moments, "embedding", "label", "id", None))
    own = openset.own_mahalanobis(rows, moments, precision).select("id", "own_d2")
    near = openset.min_mahalanobis(rows, moments, precision).select("id", "d2").join(own, "id")
    return near.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("own_d2"), 3).alias("total"),
        F.bool_and(F.col("d2") <= F.col("own_d2") + 1e-9).alias("nearest_is_least"),
    )


# The threshold lets 95 % of the training rows in; the unknown label stands for exactly those beyond it.
@query(
    "openset_full_law",
    """SELECT count(*) AS n, CAST(floor(95e-2 * (sum(CASE WHEN label < 8 THEN 1 ELSE 0 END) - 1)) AS BIGINT) + 1 AS known_inside, true AS consistent FROM embeddings""",
)
def openset_full_law(spark, sf):
    rows = fx.embeddings(spark, sf)
    known = rows.where("label < 8")
    base = centroid.simpleshot_fit(known)
    model = openset.openset_fit(known, lambda train: base.predict)
    out = model.predict(rows).select("id", "label", "y_pred", "margin")
    plain = base.predict(rows).select("id", F.col("y_pred").alias("plain"))
    expected = F.when(F.col("margin") >= 0, F.col("plain")).otherwise(-1)
    return out.join(plain, "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("label") < 8) & (F.col("margin") >= -1e-9)).alias("known_inside"),
        F.bool_and(F.col("y_pred") == expected).alias("consistent"),
    )


@query("openset_full")
def openset_full(spark, sf):
    rows = fx.embeddings(spark, sf)
    known = rows.where("label < 8")

    def base(train):
        return centroid.simpleshot_fit(train).predict

    model = openset.openset_fit(known, base)
    out = model.predict(flag_ood(rows, known))
    return rounded(out.select("id", "label", "ood", "y_pred", "margin"), 6)


@query(
    "simpleshot_report_rows",
    ELEMS
    + CENTRED
    + SHOT
    + """ SELECT CAST(vec_id AS VARCHAR) AS img_id, CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END AS score, y_true, y_pred, false AS ood,
'{"y_true":' || y_true || ',"y_pred":' || y_pred || ',"ood":false}' AS info FROM pick""",
)
def simpleshot_report_rows(spark, sf):
    rows = fx.embeddings(spark, sf)
    return run_probe(rows, rows, simpleshot())


@query("linear_probe")
def linear_probe(spark, sf):
    rows = fx.embeddings(spark, sf)
    out = probes.linear_probe(rows)(rows)
    return out.select("id", "label", "y_pred", F.round(F.array_max("probability"), 4).alias("confidence"))


@query("linear_probe_report_rows")
def linear_probe_report_rows(spark, sf):
    rows = fx.embeddings(spark, sf).withColumn("split", F.when(F.col("label") < 8, "train").otherwise("test"))
    train, test = rows.where("split = 'train'"), rows
    return run_probe(train, test, lambda part: probes.linear_probe(part)).select("img_id", "score", "info")


@query("searched_logistic_regression")
def searched_logistic_regression(spark, sf):
    rows = fx.embeddings(spark, sf)
    predict = probes.search_logreg(rows)
    return predict(rows).select("id", "label", "y_pred")


def _totals(scored, column, names):
    """(name, total) of the entries of an array column, summed over rows."""
    total = scored.select(F.posexplode(column).alias("k", "p")).groupBy("k").agg(F.sum("p").alias("total"))
    return total.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("label"), F.round("total", 3).alias("total"))


# At the optimum a free intercept makes the probabilities of a class add up to its rows.
@query("linear_probe_certificate", "SELECT label, CAST(count(*) AS DOUBLE) AS total FROM embeddings GROUP BY 1")
def linear_probe_certificate(spark, sf):
    rows = fx.embeddings(spark, sf)
    head = probes.linear_probe(rows)
    return _totals(head(rows), "probability", head.labels)


# With balanced weights every class weighs the same.
@query(
    "searched_logistic_certificate",
    "SELECT DISTINCT label, round(CAST((SELECT count(*) FROM embeddings) AS DOUBLE) / (SELECT count(DISTINCT label) FROM embeddings), 3) AS total FROM embeddings",
)
def searched_logistic_certificate(spark, sf):
    rows = fx.embeddings(spark, sf)
    head = probes.search_logreg(rows)
    weighted = balanced_weights(rows, "label", "w")
    scored = head(weighted).withColumn("weighted", F.transform("probability", lambda p: p * F.col("w")))
    return _totals(scored, "weighted", head.labels)


def task_labels(spark, sf):
    return fx.embeddings(spark, sf).select(
        "id", "embedding", F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("task"), (F.col("id") % 2).cast("int").alias("label")
    )


@query("svm_by_task")
def svm_by_task(spark, sf):
    rows = task_labels(spark, sf)
    return probes.svm_by_task(rows, rows).select("id", "task", "label", "y_pred")


# Strengths of 100 draws, five folds; the primal is within 1 % of its dual for every task.
@query("searched_svm_gaps", "SELECT DISTINCT 't' || label % 3 AS task, true AS in_range, true AS tight FROM embeddings")
def searched_svm_gaps(spark, sf):
    machines = probes.search_svm_by_task(task_labels(spark, sf))
    return machines.report().select(
        "task", F.col("c").between(1e-3, 1e1).alias("in_range"), F.col("gap").between(-1e-6, 1e-2).alias("tight")
    )


# Between landmarks the dot products of the features are the kernel itself.
@query(
    "landmark_kernel",
    ELEMS
    + f""", ld AS (SELECT vec_id FROM embeddings ORDER BY {sql_hash("'17'", "'landmark'", "vec_id")}, vec_id LIMIT 64),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM elems a JOIN elems b ON a.j = b.j
  WHERE a.vec_id IN (SELECT vec_id FROM ld) AND b.vec_id IN (SELECT vec_id FROM ld) AND a.vec_id < b.vec_id GROUP BY 1, 2)
SELECT a, b, round(exp(-5e-1 * d2), 6) AS value FROM d""",
)
def landmark_kernel(spark, sf):
    rows = fx.embeddings(spark, sf)
    features = kernels.landmark_map(rows, "rbf", 0.5, 64)(rows).select("id", "features", hash_long(17, "landmark", F.col("id")).alias("h"))
    near = features.orderBy("h", "id").limit(64).drop("h")
    pairs = near.alias("a").join(near.alias("b"), F.col("a.id") < F.col("b.id"))
    dot = F.aggregate(F.zip_with("a.features", "b.features", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return rounded(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), dot.alias("value")), 6)


@query("kernel_svm_gaps", "SELECT DISTINCT 't' || label % 3 AS task, true AS tight FROM embeddings")
def kernel_svm_gaps(spark, sf):
    rows = task_labels(spark, sf)
    mapped = kernels.landmark_map(rows, "rbf", 0.5)(rows)
    machines = probes.fit_svms(mapped, col="features", scale=False)
    return machines.report().select("task", F.col("gap").between(-1e-6, 1e-2).alias("tight"))


def labelled_bits(spark, sf):
    bits = F.array(*[(F.shiftright("label", j) % 2).cast("int") for j in range(4)])
    return fx.embeddings(spark, sf).withColumn("y", bits)


@query(
    "multilabel_probe_certificate",
    "SELECT CAST(j AS INTEGER) AS label, CAST(sum((label >> j) & 1) AS DOUBLE) AS total FROM embeddings, (SELECT unnest(range(4)) AS j) GROUP BY 1",
)
def multilabel_probe_certificate(spark, sf):
    rows = labelled_bits(spark, sf)
    return _totals(probes.multilabel_probe(rows)(rows), "scores", list(range(4)))


@query("multilabel_probe")
def multilabel_probe(spark, sf):
    rows = labelled_bits(spark, sf)
    scored = probes.multilabel_probe(rows)(rows)
    out = probes.multilabel_decide(scored, labels="y")
    return out.select("id", "label", F.round("score", 9).alias("score"))


@query(
    "multilabel_decision",
    """WITH s AS (SELECT o_orderkey, j, CAST((o_custkey >> j) & 1 AS INTEGER) AS t, CAST(((o_orderkey * (j + 3)) % 101) / 1e2 > 5e-1 AS INTEGER) AS p
FROM orders, (SELECT unnest(range(9)) AS j))
SELECT o_orderkey, round(avg(CASE WHEN t = p THEN 1e0 ELSE 0e0 END), 9) AS score, CAST(sum(p) AS BIGINT) AS n_pred FROM s GROUP BY 1""",
)
def multilabel_decision(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.array(*[(F.shiftright("o_custkey", j) % 2).cast("int") for j in range(9)]).alias("y_true"),
        F.array(*[(F.col("o_orderkey") * (j + 3)) % 101 / 100.0 for j in range(9)]).alias("scores"),
    )
    out = probes.multilabel_decide(rows)
    total = F.aggregate("y_pred", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return rounded(out.select("o_orderkey", "score", total.alias("n_pred")))


# ---- user-supplied encoders and metrics ----------------------------------

LETTERS = ["a", "e", "i", "o", "u"]


def letter_counter(ckpt):
    """Encoder that counts vowels and characters; stands for a frozen network."""

    def encode(batch):
        counts = [batch.str.count(letter).to_numpy() for letter in LETTERS]
        return np.column_stack([*counts, batch.str.len().to_numpy()])

    return encode


encoders.register_encoder("letters", letter_counter)
encoders.register_encoder("files", letter_counter, normalize=text.pretrain_ckpt)


@query(
    "embed_documents",
    "SELECT doc_id, "
    + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS n_{c}" for c in LETTERS)
    + ", CAST(length(text) AS DOUBLE) AS n_chars FROM documents",
)
def embed_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    out = encoders.embed(docs, "letters", "v1", "text")
    names = [f"n_{c}" for c in LETTERS] + ["n_chars"]
    return out.select("doc_id", *[F.get("embedding", F.lit(i)).alias(name) for i, name in enumerate(names)])


@query(
    "normalize_checkpoints",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'vit_' || p_size END AS model_ckpt FROM part",
)
def normalize_checkpoints(spark, sf):
    is_letters = F.col("p_partkey") % 2 == 0
    path = F.concat(F.lit("/a/vit_"), F.col("p_size").cast("string"), F.lit("_pretrain_web-0a1b.pth"))
    rows = fx.table(spark, sf, "part").select(
        "p_partkey",
        F.when(is_letters, "letters").otherwise("files").alias("model_org"),
        F.when(is_letters, F.col("p_brand")).otherwise(path).alias("model_ckpt"),
    )
    return encoders.normalize_ckpt(rows).drop("model_org")


def _hits(batch):
    return {"hits": float((batch["y_true"] == batch["y_pred"]).sum()), "n": float(len(batch))}


@query(
    "registered_metrics",
    f"""WITH {fx.PREDS} SELECT task_name, model_ckpt, round(avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END), 9) AS value
FROM preds WHERE task_name IN ('F', 'O') GROUP BY 1, 2""",
)
def registered_metrics(spark, sf):
    encoders.register_metric("F", metrics.micro_acc)
    encoders.register_metric("O", encoders.batch_metric(_hits, lambda hits, n: hits / n, ["hits", "n"]))
    return rounded(encoders.apply_scorer(fx.predictions(spark, sf)))
