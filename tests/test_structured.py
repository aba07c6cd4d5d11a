import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions.lifts import Hermite
from tidewright.operators import contour, embedding, fit, hankel_gram, predict, sampling, stats, thinning
from tidewright.plans import config
from tidewright.queries import ORACLES, QUERIES


def series(spark, values, parts=4):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "t long, value double").repartition(parts)


def delays(v, m, tau):
    n = len(v) - (m - 1) * tau
    return np.array([[v[t + (m - 1) * tau - d * tau] for d in range(m)] for t in range(n)])


# --- areas: numbering by ranges -----------------------------------------------------------


@pytest.mark.parametrize("partitions", [3, 8, 200])
def test_areas_of_more_rows_than_a_sample_of_ranges(spark, partitions):
    """Ranges come from a sample; places hold whatever the ranges were, and one polygon has most rows."""
    r = np.random.default_rng(partitions)
    n = 120_000
    key = np.where(r.random(n) < 0.7, 0, r.integers(1, 40, n))
    x, y = r.normal(size=n).round(3), r.normal(size=n).round(3)
    rows = spark.createDataFrame([(int(k), i, float(a), float(b)) for i, (k, a, b) in enumerate(zip(key, x, y, strict=True))], "k int, i long, x double, y double").repartition(7, "x")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.k: r.area for r in stats.signed_area(rows, ["k"]).collect()}
        placed = embedding.ranked(rows, ["k"], "i").groupBy("k").agg(F.count("t").alias("n"), F.countDistinct("t").alias("d"), F.max("t").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(p.n == p.d == p.m for p in placed)
    for k in np.unique(key):
        a, b = x[key == k], y[key == k]
        want = (a * np.roll(b, -1) - np.roll(a, -1) * b).sum() / 2
        assert math.isclose(got[int(k)], want, abs_tol=1e-6)


# --- sums over delay vectors --------------------------------------------------------------


@pytest.mark.parametrize("m,tau,shift,n", [(1, 1, 0, 30), (2, 1, 1, 30), (7, 3, 0, 60), (7, 3, 1, 60), (5, 2, 2, 40), (30, 1, 0, 31), (12, 5, 1, 60)])
def test_structured_sums(spark, m, tau, shift, n):
    v = np.random.default_rng(m).normal(size=n)
    g, count = hankel_gram.hankel_gram(series(spark, v), m, tau, shift)
    s = delays(v, m, tau)
    a, b = (s, s) if not shift else (s[:-shift], s[shift:])
    assert count == len(a) and np.allclose(g, a.T @ b, atol=1e-10)


def test_lagged_products_over_bucket_edges(spark):
    v = np.random.default_rng(2).normal(size=200)
    for bucket in (7, 50, 1000):
        (a, b) = hankel_gram.lagged_products(series(spark, v), [([0, 3, 20], 1, 150), ([5], 30, 190)], bucket=bucket)
        assert np.allclose(a, [v[:150] @ v[k : 150 + k] for k in (0, 3, 20)]) and np.allclose(b, [v[29:190] @ v[34:195]])


def test_structured_axes_are_those_of_qr(spark):
    r = np.random.default_rng(5)
    t = np.arange(3000)
    v = np.sin(0.05 * t) + 0.5 * np.cos(0.31 * t) + 0.1 * r.normal(size=3000)
    s = series(spark, v)
    u, sigma, n = hankel_gram.hankel_axes(s, 40, 2)
    w, tau = fit.principal_axes(embedding.delay_embed(s, 40, 2, []))
    assert n == 3000 - 78 and np.allclose(sigma, tau, rtol=1e-8)
    assert np.allclose(np.abs(u[:, :4].T @ w[:, :4]), np.eye(4), atol=1e-6)


def test_fits_by_structured_sums(spark):
    """The operator on leading coordinates, and whole analyses whose axes come from the sums."""
    t = np.arange(1500)
    v = np.sin(0.07 * t) + 0.4 * np.cos(0.2 * t) + 0.01 * np.random.default_rng(1).normal(size=1500)
    s = series(spark, v)
    k, u, _ = hankel_gram.hankel_operator(s, 30, 2, 4)
    z = delays(v, 30, 2) @ u
    assert np.allclose(k, np.linalg.lstsq(z[:-1], z[1:], rcond=None)[0].T, atol=1e-7)
    by_qr, by_gram = (config.hankel_analysis(s, config.Config(m_embed=30, tau_delay=2, r=4, dict_type="none", dict_params={}, axes=a)) for a in ("qr", "gram"))
    assert np.allclose(by_qr.k, by_gram.k, atol=1e-6) and np.allclose(by_qr.sigma, by_gram.sigma)
    for a in (by_qr, by_gram):
        a.release(spark)


def test_structured_sums_refuse_short_and_long(spark):
    with pytest.raises(ValueError):
        hankel_gram.hankel_gram(series(spark, range(5)), 4, 2)
    with pytest.raises(ValueError):
        hankel_gram.hankel_gram(series(spark, range(50)), 4, 2, 3)
    with pytest.raises(ValueError):
        hankel_gram.hankel_gram(series(spark, range(5)), 1 << 20, 8)


# --- level lines --------------------------------------------------------------------------


def plane(spark, f, n=24, m=20, low=-1.0, high=1.0):
    xs, ys = np.linspace(low, high, n), np.linspace(low, high, m)
    return spark.createDataFrame([(i, j, float(x), float(y), float(f(x, y))) for i, y in enumerate(ys) for j, x in enumerate(xs)], "i int, j int, x double, y double, value double").repartition(5)


def lines_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r.line, r.closed), []).append((r.place, r.x, r.y))
    return {k: [p[1:] for p in sorted(v)] for k, v in out.items()}


def test_a_circle_is_one_closed_line_around_its_inside(spark):
    points = plane(spark, lambda x, y: 0.5 - x * x - y * y)
    rows = contour.polylines(contour.segments(points)).collect()
    ((key, path),) = lines_of(rows).items()
    assert key == (1, True) and sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    x, y = np.array(path).T
    assert np.allclose(np.hypot(x, y), 0.5**0.5, atol=0.01)
    step = np.hypot(np.diff(np.append(x, x[0])), np.diff(np.append(y, y[0])))
    assert step.max() < 0.15  # neighbours follow each other
    area = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
    assert math.isclose(area, math.pi / 2, rel_tol=0.02)  # the higher side is on the left


def test_open_lines_rings_and_several_keys(spark):
    a = plane(spark, lambda x, y: x - 0.3 + 0.2 * y).withColumn("key", F.lit("line"))
    b = plane(spark, lambda x, y: 0.04 - (math.hypot(x, y) - 0.6) ** 2).withColumn("key", F.lit("rings"))
    c = plane(spark, lambda x, y: 1.0).withColumn("key", F.lit("none"))
    parts = contour.segments(a.unionByName(b).unionByName(c), by=["key"])
    rows = contour.polylines(parts, ["key"]).collect()
    assert {r.key for r in rows} == {"line", "rings"}
    ((key, path),) = lines_of([r for r in rows if r.key == "line"]).items()
    assert key == (1, False) and all(abs(x - 0.3 + 0.2 * y) < 1e-9 for x, y in path)
    assert {path[0][1], path[-1][1]} == {-1.0, 1.0}
    rings = lines_of([r for r in rows if r.key == "rings"])
    assert sorted(rings) == [(1, True), (2, True)]
    assert sorted(round(float(np.hypot(*np.array(p).T).mean()), 1) for p in rings.values()) == [0.4, 0.8]


@pytest.mark.parametrize("high", [0, 1])
def test_saddles_go_by_the_middle(spark, high):
    v = {(0, 0): 1.0 + high, (0, 1): -1.0 - (not high), (1, 1): 1.0 + high, (1, 0): -1.0 - (not high)}
    d = spark.createDataFrame([(i, j, float(j), float(i), x) for (i, j), x in v.items()], "i int, j int, x double, y double, value double")
    got = sorted((r.a, r.b) for r in contour.segments(d).collect())
    low, right, up, left = 0, 3, 2 * contour.MAX_INDEX, 1
    assert got == sorted([(low, right), (up, left)] if high else [(low, left), (up, right)])


def test_missing_corners_and_levels(spark):
    points = plane(spark, lambda x, y: x, 5, 5)
    assert contour.segments(points.where("NOT (i = 2 AND j = 2)")).count() == 2  # four cells lose a corner
    assert contour.segments(points.withColumn("value", F.when(F.col("i") == 2, F.lit(float("nan"))).otherwise(F.col("value")))).count() == 2
    assert contour.segments(points, 5.0).count() == 0 and contour.polylines(contour.segments(points, 5.0)).count() == 0
    assert contour.polylines(contour.segments(points.limit(0))).count() == 0


def test_contours_of_modes(spark):
    """Mode 1 is x - 0.25, mode 2 is y + 0.5 x."""
    d = Hermite(2, 1)
    vectors = np.array([[-0.25, 0.0], [0.0, 1.0], [1.0, 0.5]], complex)
    rows = contour.zero_contours(spark, vectors, d, np.linspace(-1, 1, 9), np.linspace(-1, 1, 11)).collect()
    assert Counter((r.mode, r.line, r.closed) for r in rows).keys() == {(1, 1, False), (2, 1, False)}
    assert all(abs(r.x - 0.25) < 1e-12 if r.mode == 1 else abs(r.y + 0.5 * r.x) < 1e-12 for r in rows)


# --- thinning and draws -------------------------------------------------------------------


def plain_thin(rows, radius):
    kept = []
    for k, x in sorted(rows):
        if all(not np.linalg.norm(np.array(x) - np.array(q)) < radius for _, q in kept):
            kept.append((k, x))
    return kept


@pytest.mark.parametrize("dim,radius", [(1, 0.05), (2, 0.15), (3, 0.3), (6, 0.9)])
def test_thinning_is_greedy_in_the_order_of_keys(spark, dim, radius):
    r = np.random.default_rng(dim)
    x = np.vstack((r.uniform(-1, 1, (300, dim)), r.normal(0, 0.01, (200, dim)))).round(4)  # a crowd in one place
    rows = [(int(k), [float(c) for c in v]) for k, v in zip(r.permutation(500), x, strict=True)]
    d = spark.createDataFrame(rows, "start long, x array<double>").withColumn("other", F.col("start") * 2).repartition(6)
    out = thinning.thinned(d, radius)
    assert out.columns == d.columns
    assert sorted((o.start, list(o.x)) for o in out.collect()) == plain_thin(rows, radius)


def test_thinning_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.01, 0.0]), (None, [5.0, 5.0]), (3, None), (4, [float("nan"), 0.0]), (5, [float("nan"), 0.0])]
    d = spark.createDataFrame(rows, "start long, x array<double>")
    assert sorted(r.start for r in thinning.thinned(d, 0.1).collect()) == [1, 4, 5]
    assert thinning.thinned(d.limit(0), 0.1).count() == 0 and thinning.thinned(d, 0.0).count() == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_draws_are_the_same_for_any_partitioning(spark, parts):
    d = spark.range(0, 3000, 3).withColumn("v", F.col("id") % 7).repartition(parts)
    out = sampling.sampled_with_replacement(d, 5000, "id", 4)
    rows = sorted((r.draw, r.id, r.v) for r in out.collect())
    import hashlib

    u = [(int(hashlib.md5(f"{k}:4:draw".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for k in range(1, 5001)]
    assert rows == [(k + 1, 3 * int(v * 1000), 3 * int(v * 1000) % 7) for k, v in enumerate(u)]
    seen = Counter(r[1] for r in rows)
    assert max(seen.values()) > 8 and 980 < len(seen) <= 1000  # with replacement, nearly all rows
    assert sampling.sampled_with_replacement(d.limit(0), 5, "id").count() == 0


# --- roll-outs from every start -----------------------------------------------------------


@pytest.mark.parametrize("bucket", [1, 13, 1 << 20])
def test_rollouts_cross_buckets(spark, bucket):
    v = np.sin(0.3 * np.arange(80))
    states = embedding.delay_embed(series(spark, v), 3, 1, [])
    move = np.array([[0.9, 0.1, 0.0], [0.0, 0.8, 0.2], [0.1, 0.0, 0.7]])
    s = delays(v, 3, 1)
    for starts in (None, [1, 30, 73]):
        out = predict.rolled_out(states, starts, 5, predict.moved_by(lambda x: np.tanh(x @ move)), bucket).collect()
        asked = range(1, len(s) - 4) if starts is None else starts
        assert sorted({r.start_idx for r in out}) == sorted(asked) and len(out) == 6 * len(list(asked))
        for r in out:
            x = s[r.start_idx - 1]
            for _ in range(r.step):
                x = np.tanh(x @ move)
            assert math.isclose(r.x_pred, x[0], abs_tol=1e-12) and r.x_true == s[r.start_idx - 1 + r.step, 0]
    with pytest.raises(ValueError):
        predict.rolled_out(states, [75], 5, predict.moved_by(lambda x: x))


# --- nothing is kept ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["analysis_hermite", "analysis_kernel", "analysis_havok", "operator_none", "hankel_prediction", "nearest_embeddings", "fnn_fraction", "signed_area"])
def test_queries_leave_nothing_in_storage(spark, data, name):
    QUERIES[name](spark, data).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_an_overwritten_table_is_read_anew(spark, tmp_path):
    """Nothing that an earlier run has stored answers for a later one."""
    def save(scale):
        rows = [(i, i, scale * math.sin(0.1 * i) + 0.01 * (i * 7919 % 13)) for i in range(400)]
        d = spark.createDataFrame(rows, "event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        d.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")

    save(1.0)
    first = [tuple(r)[:3] for r in QUERIES["analysis_hermite"](spark, str(tmp_path)).collect()]
    save(300.0)
    assert [tuple(r)[:3] for r in QUERIES["analysis_hermite"](spark, str(tmp_path)).collect()] != first


def test_oracles_of_the_new_queries():
    assert {"hankel_gram", "zero_contour", "thinned_customers", "drawn_orders", "delay_prediction", "kernel_prediction", "forced_prediction"} <= set(ORACLES)
