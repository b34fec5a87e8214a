"""Bit-sliced scatter against direct sums, whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from evalspark.llm import bit_whitening as bw


@pytest.mark.parametrize("high", [1, 5, 1000, 2**40])
@pytest.mark.parametrize("rows", [1, 63, 64, 130])
def test_cross_products_are_exact(high, rows):
    z = np.random.default_rng(rows).integers(-high, high, (rows, 5))
    sums, cross = bw.cross_products(z)
    big = z.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    assert cross.tolist() == (big.T @ big).tolist()


def by_hand(vectors, components=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    v = np.array((n * fit - s).T @ (n * fit - s), dtype=float) / n**3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = np.array((n * x - s), dtype=float) / n @ u / np.sqrt(e)
    return n, ((n * x - s) ** 2).sum(axis=1), w, e / np.trace(v)


@pytest.mark.parametrize("scale", [0.2, 3e8])
@pytest.mark.parametrize("dim", [3, 24])
def test_whitened_rows(spark, scale, dim, monkeypatch):
    monkeypatch.setattr(bw, "STEP_ROWS", 50)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim)) * np.linspace(1, 3, dim) * scale
    x = np.concatenate([x, x[:40], np.repeat(x[:1], 60, axis=0)])
    odd = [(900, None), (901, [float("nan")] * dim), (902, [None] * dim), (903, [float("inf")] * dim), (904, [1.0]), (905, []), (906, [1e300] * dim)]
    rows = [(int(i) if i else None, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS n", "2 AS z", "'a' AS component")
    got = bw.whiten(df).collect()
    k = min(16, dim)
    n, deviation, white, explained = by_hand(x)
    assert len(got) == len(x) * k and {r["n"] for r in got} == {n} == {150}
    assert max(r["identity_error"] for r in got) < 1e-9
    signs = {}
    for r in got:
        i, c = r["vec_id"] or 0, r["component"] - 1
        signs.setdefault(c, np.sign(r["whitened"] * white[i, c]))
        assert r["whitened"] == pytest.approx(signs[c] * white[i, c], abs=1e-7)
        assert int(r["deviation"]) == deviation[i]
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert bw.whiten(df).count() == 0
    assert bw.whiten(df.where("false")).count() == 0
    assert bw.whiten(df.where("vec_id = 3")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimensions_give_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    got = bw.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20
    assert got[0]["explained"] == pytest.approx(1)
