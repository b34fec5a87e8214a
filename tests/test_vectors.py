"""Neighbours, centroids, open-set detection and probes against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions import vectors
from evalspark.operators import centroid, encoders, kernels, neighbours, openset, probes


def frame(spark, x, y=None):
    y = np.zeros(len(x), dtype=int) if y is None else y
    rows = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, label int")


def brute_neighbours(x, k, queries=None):
    q = x if queries is None else queries
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    if queries is None:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    return {(i, r + 1): (int(j), round(d[i, j], 6)) for i in range(len(q)) for r, j in enumerate(order[i])}


def found(df):
    return {(r["qid"], r["rank"]): (r["rid"], round(r["dist"], 6)) for r in df.collect()}


def clustered(seed=0, n=240, d=6):
    """Clusters, with a third of the rows copies of one vector."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 5 + rng.normal(size=(n, d))
    x[: n // 3] = np.round(x[0], 3)
    return x


@pytest.mark.parametrize("chunk_rows, query_rows", [(4096, 8192), (20, 16), (7, 1000)])
def test_neighbours_are_exact_on_every_path(spark, limits, chunk_rows, query_rows):
    x = clustered()
    limits("chunkRows", chunk_rows)
    limits("queryRows", query_rows)
    got = found(neighbours.knn_join(frame(spark, x), frame(spark, x), 5, exclude_self=True))
    want = brute_neighbours(x, 5)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got == want


def test_other_queries_and_small_reference(spark, limits):
    x = clustered(1, 90)
    q = np.random.default_rng(2).normal(size=(25, 6)) * 8
    limits("chunkRows", 9)
    got = found(neighbours.knn_join(frame(spark, q), frame(spark, x), 3))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in brute_neighbours(x, 3, q).items()}
    few = found(neighbours.knn_join(frame(spark, q), frame(spark, x[:2]), 3))
    assert len(few) == 50


def test_queries_travel_to_a_bounded_number_of_chunks(spark, monkeypatch):
    sent = []
    search = neighbours._search

    def counted(queries, *rest):
        sent.append(queries.select("chunk").distinct().count())
        return search(queries, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 4)
    x = np.random.default_rng(3).normal(size=(240, 6))
    got = found(neighbours.knn_join(frame(spark, x), frame(spark, x), 5, exclude_self=True))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in brute_neighbours(x, 5).items()}
    # A cell's last chunk may be a small one.
    assert len(sent) == 2 and max(sent) <= 2 * 16


@pytest.mark.parametrize("chunk_rows, query_rows", [(4096, 8192), (40, 64)])
def test_near_copies_far_from_zero_keep_their_order(spark, limits, chunk_rows, query_rows):
    rng = np.random.default_rng(7)
    x = (1e3 + rng.normal(size=(200, 4)) * 1e-4).astype(np.float32).astype(float)
    limits("chunkRows", chunk_rows)
    limits("queryRows", query_rows)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = {(r["qid"], r["rank"]): r["rid"] for r in neighbours.knn_join(frame(spark, x), frame(spark, x), 5, exclude_self=True).collect()}
    assert got == {(i, r + 1): int(j) for i in range(200) for r, j in enumerate(order[i])}


def test_tiles_do_not_change_the_nearest_rows(monkeypatch):
    x = np.concatenate([clustered(5), [[np.nan] * 6, [np.inf] * 6]])
    whole = neighbours.nearest_rows(x, x, 7)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 11)
    monkeypatch.setattr(neighbours, "TILE_POINTS", 5)
    monkeypatch.setattr(neighbours, "TILE_PAIRS", 3)
    cut = neighbours.nearest_rows(x, x, 7)
    assert len(whole[0]) == 240 * 7
    # The common offset that is subtracted does not depend on the tiles, so all three agree to the bit.
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_vectors_that_are_not_finite_have_no_neighbours(spark, limits):
    x = np.concatenate([clustered(6, 60), [[np.nan] * 6, [np.inf] * 6]])
    for rows in (4096, 9):
        limits("chunkRows", rows)
        got = neighbours.knn_join(frame(spark, x), frame(spark, x), 2).collect()
        assert len(got) == 120 and max(r["rid"] for r in got) < 60
    centres = frame(spark, x[:5]).select(F.col("id").cast("int").alias("label"), "embedding")
    for size in (2**28, 10):
        limits("modelBytes", size)
        scored = centroid.nearest_centroid(frame(spark, x).drop("label"), centres).where("y_pred IS NULL").collect()
        assert sorted(r["id"] for r in scored) == [60, 61]


def test_vote_recovers_clusters(spark):
    rng = np.random.default_rng(0)
    y = np.arange(60) % 3
    x = np.eye(3)[y] * 10 + rng.normal(size=(60, 3))
    out = neighbours.knn_vote(frame(spark, x, y)).collect()
    assert len(out) == 60 and all(r["y_true"] == r["y_pred"] for r in out)


def test_nearest_centroid_paths_agree(spark, limits):
    x = clustered(3)
    centres = frame(spark, np.random.default_rng(4).normal(size=(30, 6)) * 4).select(F.col("id").cast("int").alias("label"), "embedding")
    small = {r["id"]: r["y_pred"] for r in centroid.nearest_centroid(frame(spark, x).drop("label"), centres).collect()}
    limits("modelBytes", 10)
    limits("chunkRows", 8)
    large = {r["id"]: r["y_pred"] for r in centroid.nearest_centroid(frame(spark, x).drop("label"), centres).collect()}
    assert small == large and len(small) == 240


def test_simpleshot_returns_class_labels(spark):
    rng = np.random.default_rng(0)
    y = np.array([7, 11, 30])[np.arange(90) % 3]
    x = np.eye(3)[np.arange(90) % 3] * 6 + rng.normal(size=(90, 3))
    df = frame(spark, x, y)
    out = centroid.simpleshot_fit(df).predict(df).collect()
    assert all(r["label"] == r["y_pred"] for r in out)


def ledoit_wolf(z):
    n, d = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / (d * n * n)
    return min(beta, delta) / delta


@pytest.mark.parametrize("block", [8192, 16])
def test_pooled_covariance_with_shrinkage(spark, monkeypatch, block):
    monkeypatch.setattr(openset, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 5)) * [1, 2, 3, 0.5, 1] + y[:, None]
    want = np.zeros((5, 5))
    for c in range(3):
        part = x[y == c]
        sd = part.std(0)
        z = (part - part.mean(0)) / sd
        s = ledoit_wolf(z)
        emp = z.T @ z / len(z)
        shrunk = (1 - s) * emp + s * np.trace(emp) / 5 * np.eye(5)
        want += len(part) / 150 * shrunk * np.outer(sd, sd)
    df = frame(spark, x, y)
    moments = openset.class_moments(df, "embedding", "label")
    assert np.allclose(openset.pooled_covariance(df, moments, "embedding", "label", "id"), want)


def test_mahalanobis_modes(spark):
    rng = np.random.default_rng(2)
    x, mu = rng.normal(size=(40, 4)), rng.normal(size=(3, 4))
    root = rng.normal(size=(4, 4))
    precision = root @ root.T + np.eye(4)
    means = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(mu)], "label int, mean array<double>")
    diff = x[:, None] - mu[None]
    for diagonal, p in ((False, precision), (True, np.diag(np.diag(precision)))):
        want = np.einsum("ncd,de,nce->nc", diff, p, diff).min(1)
        rows = openset.min_mahalanobis(frame(spark, x).drop("label"), means, precision, diagonal=diagonal).collect()
        got = np.array([r["d2"] for r in sorted(rows, key=lambda r: r["id"])])
        assert np.allclose(got, want) and (got >= 0).all()


def test_far_points_are_unknown(spark):
    train = frame(spark, [[-2.0], [-1.5], [-1.0], [1.0], [1.5], [2.0]], [0, 0, 0, 1, 1, 1])

    def base(df):
        means = vectors.pool_mean(df, ["label"], "embedding")
        return lambda rows: centroid.nearest_centroid(rows.drop("label"), means).drop("dist")

    model = openset.openset_fit(train, base)
    out = {r["id"]: r["y_pred"] for r in model.predict(frame(spark, [[-1.5], [1.2], [100.0], [-50.0]])).collect()}
    assert out == {0: 0, 1: 1, 2: -1, 3: -1}


def separable(spark, n=120, classes=3):
    rng = np.random.default_rng(0)
    y = np.arange(n) % classes
    return frame(spark, np.eye(4)[y] * 4 + rng.normal(size=(n, 4)) * 0.3, y)


def accuracy(df, label="label"):
    return df.agg(F.avg((F.col(label) == F.col("y_pred")).cast("double"))).first()[0]


def test_linear_probe(spark):
    df = separable(spark)
    out = probes.linear_probe(df, max_iter=30)(df)
    assert accuracy(out) > 0.95
    assert out.select(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p).alias("s")).first()["s"] == pytest.approx(1)


def test_searched_logistic_regression(spark):
    df = separable(spark)
    assert accuracy(probes.search_logreg(df, n_iter=2, folds=2, max_iter=20)(df)) > 0.95


def test_joint_svm_equals_separate_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) + 1
    task, side = np.arange(120) % 2, rng.integers(0, 2, 120)
    x[:, 0] += np.where(side, 2.0, -2.0) * np.where(task, 1, -1)
    df = frame(spark, x, side).withColumn("task", F.concat(F.lit("t"), (F.col("id") % 2).cast("string")))
    joint = probes.svm_by_task(df, df)
    assert accuracy(joint) > 0.95
    alone = probes.svm_by_task(df.where("task = 't0'"), df.where("task = 't0'"))
    pair = joint.select("id", F.col("y_pred").alias("a")).join(alone.select("id", F.col("y_pred").alias("b")), "id")
    assert pair.where("a <> b").count() <= 1


def test_multilabel_probe(spark):
    df = separable(spark).withColumn("y", F.array((F.col("label") == 0).cast("int"), (F.col("label") != 1).cast("int")))
    out = probes.multilabel_decide(probes.multilabel_probe(df)(df), labels="y")
    assert out.agg(F.avg("score")).first()[0] > 0.95


def test_encoder_registry(spark, caplog):
    def load(ckpt):
        def encode(batch):
            flat = np.column_stack([batch.str.len(), batch.str.count(ckpt)])
            return flat, np.stack([flat, flat + 1], axis=1)

        return encode

    encoders.register_encoder("pairs", load, patches=True)
    encoders.register_encoder("pairs", load, patches=True)
    assert "Overwriting" in caplog.text and "pairs" in encoders.list_encoders()
    df = spark.createDataFrame([(1, "banana"), (2, "x")], "id int, s string")
    out = {r["id"]: (r["embedding"], r["patches"]) for r in encoders.embed(df, "pairs", "a", "s").collect()}
    assert out == {1: ([6.0, 3.0], [[6.0, 3.0], [7.0, 4.0]]), 2: ([1.0, 0.0], [[1.0, 0.0], [2.0, 1.0]])}
    with pytest.raises(ValueError):
        encoders.embed(df, "absent", "a", "s")


def test_layer_norm_far_from_zero(spark):
    x = 3000 + 0.01 * np.random.default_rng(0).normal(size=64)
    row = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(vectors.layer_norm(F.col("v")).alias("v")).first()
    assert np.allclose(row["v"], (x - x.mean()) / np.sqrt(x.var() + 1e-5), atol=1e-9)


def test_singular_covariance(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 5))
    precision = openset.precision_of(np.cov(flat.T))
    root = openset.whitening(precision)
    assert np.allclose(root @ root.T, np.linalg.pinv(np.cov(flat.T), rcond=1e-10))


def test_quantile_by_rank(spark):
    values = np.random.default_rng(2).normal(size=101)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, d double")
    for pct in (0.0, 0.5, 0.95, 1.0):
        assert np.isclose(openset.quantile(df, "d", "id", pct), np.quantile(values, pct))


def plain_optimum(loss, width):
    """Gradient descent with numerical care is not needed: the losses are smooth and convex in few dimensions."""
    w = np.zeros(width)
    for _ in range(200):
        g, h = loss(w)
        w = w - np.linalg.solve(h + 1e-9 * np.eye(width), g)
    return w


def test_trait_models_are_optimal(spark):
    """Joint binary fits with free intercepts against Newton's method on each trait."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) + 2
    y = (x @ np.array([[1.0, -2, 0.5], [0, 1, 1]]).T + rng.normal(size=(200, 2)) > 1).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(200)], "embedding array<double>, y array<int>")
    got = np.array([r["scores"] for r in probes.multilabel_probe(df, penalty=0.05)(df).collect()])
    order = [r["embedding"] for r in df.collect()]
    full = np.concatenate([np.array(order), np.ones((200, 1))], axis=1)
    truth = np.array([r["y"] for r in df.collect()])
    free = np.diag([0.05, 0.05, 0.05, 0.0])
    for t in range(2):

        def newton(w, t=t):
            p = 1 / (1 + np.exp(-full @ w))
            return full.T @ (p - truth[:, t]) / 200 + free @ w, (full * (p * (1 - p))[:, None]).T @ full / 200 + free

        w = plain_optimum(newton, 4)
        assert np.allclose(got[:, t], 1 / (1 + np.exp(-full @ w)), atol=1e-5)


def test_searched_regression_picks_and_refits(spark):
    """The refit minimises its objective, and equal scores keep the first strength."""
    df = separable(spark, 90)
    head = probes.search_logreg(df, n_iter=4, folds=3)
    x, y = np.array([r["embedding"] for r in df.collect()]), np.array([r["label"] for r in df.collect()])
    z = np.concatenate([(x - head.center) / head.spread, np.ones((len(x), 1))], axis=1)
    p = probes.joint.softmax(z @ head.weights)
    p[np.arange(len(y)), y] -= 1
    weight = len(y) / (len(head.labels) * np.bincount(y)[y])
    slope = z.T @ (p * weight[:, None])
    slope[:-1] += head.weights[:-1] / head.strength
    assert np.abs(slope / len(y)).max() < 1e-7
    assert 1e-3 <= head.strength <= 10
    assert np.allclose(head.center, x.mean(axis=0)) and np.allclose(head.spread, x.std(axis=0))


def test_machines_close_their_duality_gap(spark, limits):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    task, side = np.arange(150) % 3, (x[:, 0] + 0.3 * rng.normal(size=150) > 0.5).astype(int)
    df = frame(spark, x, side).withColumn("task", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    whole = probes.fit_svms(df, strengths=[0.01, 1.0, 5.0], folds=3)
    rows = {r["task"]: r for r in whole.report().collect()}
    assert set(rows) == {"t0", "t1", "t2"} and all(-1e-6 <= r["gap"] < 0.02 for r in rows.values())
    limits("modelBytes", 8 * 2 * 30 * 4 * 9)
    sliced = probes.fit_svms(df, strengths=[0.01, 1.0, 5.0], folds=3)
    assert np.allclose(sliced.weights, whole.weights, atol=1e-3) and (sliced.strengths == whole.strengths).all()
    assert accuracy(whole(df)) > 0.7


def test_registered_searches_are_whole(spark, monkeypatch):
    """The registered queries draw and iterate as often as the reference, until the gradient vanishes."""
    from evalspark.catalog import vectors as catalog

    seen = []
    plain = probes.joint.minimize

    def watched(rows, kernel, penalty, start, scale, max_iter=1000, tolerance=probes.joint.TOLERANCE):
        w = plain(rows, kernel, penalty, start, scale, max_iter, tolerance)
        flat = probes.joint.added(rows, lambda c: np.concatenate([part.ravel() for part in kernel(c, w)]))
        slope = flat[len(w) :].reshape(w.shape) / scale[:, None] + penalty * w
        seen.append((len(w), np.abs(slope).max() / tolerance))
        return w

    monkeypatch.setattr(probes.joint, "minimize", watched)
    folder = "/root/testdata/sf0.001"
    for name, most in (("linear_probe", 1), ("linear_probe_report_rows", 1), ("multilabel_probe", 4), ("searched_logistic_regression", 150)):
        seen.clear()
        assert getattr(catalog, name)(spark, folder).count() == 500
        # Rounding may stop a model a little above the tolerance.
        assert max(n for n, _ in seen) == most and all(off < 100 for _, off in seen), (name, seen)


@pytest.mark.parametrize("kind, gamma", [("rbf", 0.7), ("poly", 0.4), ("sigmoid", 0.1), ("linear", 1.0)])
def test_landmark_features_give_the_kernel(spark, kind, gamma):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    df = frame(spark, x, np.zeros(40, int))
    whole = kernels.landmark_map(df, kind, gamma, 40)
    exact = kernels.kernel_matrix(x, x, kind, gamma)
    values, axes = np.linalg.eigh((exact + exact.T) / 2)
    # A kernel with negative values keeps its positive part.
    exact = (axes * np.maximum(values, 0)) @ axes.T
    features = np.array([r["features"] for r in whole(df).orderBy("id").collect()])
    assert np.allclose(features @ features.T, exact, atol=1e-6)
    few = kernels.landmark_map(df, kind, gamma, 25)
    features = np.array([r["features"] for r in few(df).orderBy("id").collect()])
    if kind != "sigmoid":
        # What fewer landmarks leave out is positive: the features never exceed the kernel.
        assert np.linalg.eigvalsh(exact - features @ features.T).min() > -1e-6 * np.abs(exact).max()
    with pytest.raises(ValueError):
        kernels.kernel_matrix(x, x, "other", 1.0)


def test_kernel_machine_equals_its_dual(spark):
    """Rings that no line parts; the margins are those of the dual solved by projected coordinate steps."""
    rng = np.random.default_rng(7)
    angle, ring = rng.uniform(0, 6.28, 80), np.arange(80) % 2
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (1 + ring)[:, None] + rng.normal(size=(80, 2)) * 0.1
    df = frame(spark, x, ring).withColumn("task", F.lit("t"))
    mapped = kernels.landmark_map(df, "rbf", 1.0, 80)(df)
    machine = probes.fit_svms(mapped, col="features", strengths=[1.0], scale=False)
    assert accuracy(machine(mapped)) == 1.0 and machine.report().first()["gap"] < 0.01
    k, y = kernels.kernel_matrix(x, x, "rbf", 1.0), 2.0 * ring - 1
    alpha = np.zeros(80)
    for _ in range(300):  # pairs keep the sum by label at zero
        g = 1 - y * (k @ (alpha * y))
        up = np.where((y > 0) & (alpha < 1) | (y < 0) & (alpha > 0), y * g, -np.inf)
        low = np.where((y > 0) & (alpha > 0) | (y < 0) & (alpha < 1), y * g, np.inf)
        i, j = up.argmax(), low.argmin()
        if up[i] - low[j] < 1e-9:
            break
        step = (up[i] - low[j]) / (k[i, i] + k[j, j] - 2 * k[i, j])
        step = min(step, (1 - alpha[i]) if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else (1 - alpha[j]))
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
    dual = alpha.sum() - (alpha * y) @ k @ (alpha * y) / 2
    primal_w = (machine.weights[0, :-1] ** 2).sum() / 2
    features = np.array([r["features"] for r in mapped.orderBy("id").collect()])
    slack = np.maximum(0, 1 - y * (features @ machine.weights[0, :-1] + machine.weights[0, -1])).sum()
    assert primal_w + slack == pytest.approx(dual, rel=0.01)
