"""Whole analyses against NumPy: embedding, axes, dictionary, fit and spectrum from the definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions.vectors import EPS
from tidewright.plans import config


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    t = np.arange(600)
    return np.sin(0.21 * t) + 0.4 * np.sin(0.055 * t + 1) + 0.05 * rng.normal(size=600)


@pytest.fixture(scope="module")
def series(spark, values):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "t long, value double").repartition(4)


def delays(values, m, tau):
    reach = (m - 1) * tau
    return np.array([values[i : i - reach - 1 if i > reach else None : -tau][:m] for i in range(reach, len(values))])


def axes(s, r):
    u = np.linalg.svd(s.T, full_matrices=False)[0][:, :r]
    return u * np.where(u[np.abs(u).argmax(0), np.arange(r)] < 0, -1, 1)


def lifted(kind, d, x):
    """Features from the formulas, given the learned centres or frequencies."""
    if kind == "hermite":
        one, a = np.ones(len(x)), x.T
        by_degree = {0: [one], 1: [v for v in a[::-1]]}
        # of two degrees: products and x^2 - 1, later variables first
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        exponent = lambda p: tuple((p[0] == k) + (p[1] == k) for k in range(3))
        by_degree[2] = [a[i] * a[j] - (i == j) for i, j in sorted(pairs, key=exponent)]
        return np.column_stack([v for k in (0, 1, 2) for v in by_degree[k]])
    if kind == "rbf":
        c = np.array(d.centers)
        r = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2)) + 1e-12
        return np.hstack((np.ones((len(x), 1)), x, r * r * np.log(r)))
    w, b = np.array(d.w), np.array(d.b)
    return np.hstack((x, np.sqrt(2 / len(b)) * np.cos(x @ w.T + b)))


@pytest.mark.parametrize("kind,params", [("hermite", {"max_deg": 2}), ("rbf", {"n_rbf": 16}), ("rff", {"D": 30, "include_states": True, "sigma": 2.0})])
def test_fits_with_a_dictionary(series, values, kind, params):
    c = config.Config(m_embed=12, tau_delay=2, r=3, dict_type=kind, dict_params=params, edmd_alpha=1e-3, seed=3)
    a = config.hankel_analysis(series, c)
    s = delays(values, 12, 2)
    u = axes(s, 3)
    assert np.allclose(a.u, u, atol=1e-8)
    psi = lifted(kind, a.dictionary, s @ u)
    g = psi[:-1].T @ psi[:-1] + 1e-3 * np.eye(psi.shape[1])
    k = np.linalg.solve(g, psi[:-1].T @ psi[1:])
    assert np.allclose(a.k, k, atol=1e-6 * np.abs(k).max())
    if kind != "hermite":
        b = np.linalg.solve(psi[:-1].T @ psi[:-1] + c.proj_alpha * np.eye(psi.shape[1]), psi[:-1].T @ (s @ u)[:-1]).T
        assert np.allclose(psi @ a.b_reduced.T, psi @ b.T, atol=1e-6)
    pred = {(r.start_idx, r.step): r.x_pred for r in a.predict([5, 300], 4).collect()}
    for start in (5, 300):
        p = psi[start - 1]
        for step in range(5):
            assert np.isclose(pred[(start, step)], (a.b @ p)[0], atol=1e-8)
            p = a.k.T @ p
    a.release(series.sparkSession)


def test_the_linear_fit(series, values):
    a = config.hankel_analysis(series, config.Config(m_embed=20, tau_delay=1, r=4, dict_type="none", dict_params={}))
    s = delays(values, 20, 1)
    u = axes(s, 4)
    x = s @ u
    small = np.linalg.lstsq(x[:-1], x[1:], rcond=EPS)[0].T
    assert np.allclose(a.k, u @ small @ u.T, atol=1e-8)
    want = np.linalg.eigvals(small)
    got = a.spectrum[0][:4]
    assert np.allclose(sorted(np.abs(got)), sorted(np.abs(want)), atol=1e-8)


@pytest.mark.parametrize("m,r", [(15, 4), (500, 3)])
def test_the_forced_fit(spark, m, r):
    """Of 500 delays as well: strides, sums of whole rows, one matrix to the driver."""
    t = np.arange(900)
    v = np.sin(0.11 * t) + 0.3 * np.sin(0.031 * t)
    d = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(v)], "t long, value double").repartition(3)
    a = config.hankel_analysis(d, config.Config(m_embed=m, tau_delay=1, r=r, dict_type="havok", dict_params={}, dt=0.1))
    s = delays(v, m, 1)
    assert a.u.shape == (m, r) and np.allclose(a.sigma[:r], np.linalg.svd(s, compute_uv=False)[:r], rtol=1e-6)
    w = s @ a.u
    assert np.allclose(np.abs(np.sum(a.u * axes(s, r), 0)), 1, atol=1e-5)
    lead = w[:, : r - 1]
    rate = (-lead[4:] + 8 * lead[3:-1] - 8 * lead[1:-3] + lead[:-4]) / 1.2
    ab = np.linalg.lstsq(w[2:-2], rate, rcond=None)[0].T
    assert np.allclose(np.hstack((a.forcing[0], a.forcing[1][:, None])), ab, atol=1e-5 * np.abs(ab).max())
    whole = np.zeros((r, r))
    whole[: r - 1] = ab
    term, exp = np.eye(r), np.eye(r)
    for k in range(1, 30):
        term = term @ whole * 0.1 / k
        exp = exp + term
    assert np.allclose(a.k, exp, atol=1e-5)


def test_the_pairs_are_the_basis(series, values):
    c = config.Config(m_embed=4, tau_delay=1, r=2, dict_type="kernel", dict_params={"sigma": 1.2, "alpha": 1e-4})
    d = series.where(F.col("t") <= 60)
    a = config.hankel_analysis(d, c)
    x = delays(values[:60], 4, 1) @ axes(delays(values[:60], 4, 1), 2)
    gram = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / (2 * 1.2**2))
    xx, xy = gram(x[:-1], x[:-1]), gram(x[:-1], x[1:])
    assert np.allclose(a.kernel.gram_xx, xx, atol=1e-9) and np.allclose(a.kernel.gram_xy, xy, atol=1e-9)
    inv = np.linalg.inv(xx + 1e-4 * np.eye(len(xx)))
    assert np.allclose(a.k, inv @ xy, atol=1e-6 * np.abs(inv @ xy).max()) and np.allclose(a.kernel.b, x[:-1].T @ inv, atol=1e-6)
