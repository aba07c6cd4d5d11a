import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import diagnostics, fit, kernel_cg, kernel_nodes, spectral, spectral_keys
from tidewright.shared import shared_root

# --- many spectra at once -----------------------------------------------------------------


def mode_rows(seed, keys):
    """Spectra with turning pairs, powers of one another, real modes and, in some, none of a kind."""
    r = np.random.default_rng(seed)
    out = {}
    for key in range(keys):
        values = []
        for a in r.uniform(0.1, 1.2, r.integers(0, 4)):
            radius = r.choice([1.0, 1.0, 0.99, 1.03, 0.8])
            for h in range(1, r.integers(1, 5)):
                z = (radius * np.exp(1j * a)) ** h * (1 + r.normal(0, 0.004))
                values += [z, z.conj()] if r.random() < 0.9 else [z]
        if values and r.random() < 0.8:
            values[0] = values[0] / abs(values[0])
        values += list(r.choice([1.0, 0.9, 0.5, -0.3, 0.0], r.integers(0, 3)).astype(complex))
        values = np.array(values, complex)
        out[key] = values[r.permutation(len(values))]
    return out


def table(spark, modes):
    rows = [(k, i + 1, float(v.real), float(v.imag)) for k, vs in modes.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key int, k int, re double, im double").repartition(4)


@pytest.mark.parametrize("branch_growth", [1.0, 0.6])
def test_families_of_all_keys_are_those_of_each(spark, branch_growth):
    modes = mode_rows(4, 40)
    got = {}
    for r in spectral_keys.harmonic_families(table(spark, modes), ["key"], 0.1, branch_growth=branch_growth).collect():
        got.setdefault(r.key, {}).setdefault(r.branch, []).append(r.k - 1)
    for key, values in modes.items():
        want = spectral.harmonic_branches(values, 0.1, branch_growth=branch_growth) if len(values) else {}
        assert {b: sorted(ks) for b, ks in got.get(key, {}).items()} == want


def test_many_families_take_few_jobs(spark):
    """Hundreds of families in a key, some modes many times: jobs don't grow with them."""
    r = np.random.default_rng(12)
    crowd = np.exp(1j * r.uniform(0.05, 3.0, 250)) * r.uniform(0.96, 1.04, 250)
    same = np.repeat(np.exp(1j * np.array([0.37, 0.74, 1.11, 5.55])), 40)
    modes = {0: np.concatenate((crowd, same)), 1: same, 2: np.array([1.0, 0.5], complex)}
    spark.sparkContext.setJobGroup("families", "families")
    got = {}
    for row in spectral_keys.harmonic_families(table(spark, modes), ["key"], 0.1).collect():
        got.setdefault(row.key, {}).setdefault(row.branch, []).append(row.k - 1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("families")) < 40
    for key, values in modes.items():
        assert {b: sorted(ks) for b, ks in got.get(key, {}).items()} == spectral.harmonic_branches(values, 0.1)
    assert len(got[0]) > 100


def test_phase_and_amplitude_of_all_keys(spark):
    modes = mode_rows(6, 60)
    out, families = spectral_keys.phase_and_amplitude(table(spark, modes), ["key"], 0.1)
    got, members = {r.key: r for r in out.collect()}, {}
    for r in families.collect():
        members.setdefault(r.key, set()).add(r.k - 1)
    assert len(got) > 10
    for key, values in modes.items():
        try:
            j, mu, a, nu, branch = spectral.phase_amplitude_modes(values, 0.1)
        except ValueError:
            assert key not in got and key not in members
            continue
        g = got[key]
        assert (g.phase_k, g.amplitude_k) == (j + 1, a + 1) and members[key] == set(branch)
        assert np.allclose([g.phase_re, g.phase_im, g.amplitude_re, g.amplitude_im], [mu.real, mu.imag, nu.real, nu.imag])


def test_spectra_of_all_keys(spark):
    r = np.random.default_rng(1)
    m = {k: r.normal(size=(n, n)) for k, n in (("a", 3), ("b", 5), ("c", 1))}
    rows = [(k, i + 1, j + 1, float(v)) for k, a in m.items() for (i, j), v in np.ndenumerate(a)]
    out = spectral_keys.spectra(spark.createDataFrame(rows, "key string, i int, j int, value double"), ["key"]).collect()
    assert len(out) == 9
    for o in out:
        xi = np.array(o.xi_re) + 1j * np.array(o.xi_im)
        assert np.allclose(m[o.key] @ xi, (o.re + 1j * o.im) * xi)
        assert np.isclose(spectral.eigendecomposition(m[o.key])[0][o.k - 1], o.re + 1j * o.im)
    top = spectral_keys.leading(spark.createDataFrame([(o.key, o.k, o.re, o.im) for o in out], "key string, k int, re double, im double"), ["key"], 2).collect()
    assert sorted((t.key, t.k, t.place) for t in top) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1)]
    assert spectral_keys.harmonic_families(table(spark, {}), ["key"], 0.1).count() == 0


def test_jacobians_of_a_table(spark):
    d = spark.createDataFrame([(1, [2.0, 3.0]), (2, [0.0, -1.0])], "id int, x array<double>")
    got = {(r.id, r.i, r.j): r.value for r in diagnostics.jacobians(d, lambda x: np.stack((x[:, 0] ** 2 + x[:, 1], x[:, 0] * x[:, 1]), 1), ["id"]).collect()}
    want = {(1, 1, 1): 4, (1, 1, 2): 1, (1, 2, 1): 3, (1, 2, 2): 2, (2, 1, 1): 0, (2, 1, 2): 1, (2, 2, 1): -1, (2, 2, 2): 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


# --- kernels over all pairs ---------------------------------------------------------------


def test_all_pairs_against_dense_numpy(spark):
    r = np.random.default_rng(7)
    x, sigma, alpha = r.normal(size=(2000, 3)), 0.9, 1e-3
    y = np.stack((np.sin(x[:, 0]) + x[:, 1], x[:, 2] ** 2), 1)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t long, x array<double>, y array<double>").repartition(5)
    found = kernel_cg.solve_kernel(rows, sigma, alpha, landmarks=600, tol=1e-8, block=600)
    k = kernel_cg.gaussian(x, x, sigma)
    w = np.linalg.solve(k + alpha * np.eye(2000), y)
    assert found.count == 4 and found.passes < 60 and (found.residual <= 1.1e-8).all()
    got = np.zeros_like(w)
    for b in found.blocks.collect():
        got[np.frombuffer(b["keys"], "<i8")] = kernel_cg.unpacked(b["p"], 2)
    assert np.linalg.norm((k + alpha * np.eye(2000)) @ got - y) <= 2e-8 * np.linalg.norm(y)
    at = r.normal(size=(50, 3))
    points = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(at)], "t long, x array<double>")
    out = np.array([q.y for q in found.evaluate(points).orderBy("t").collect()])
    assert np.allclose(out, kernel_cg.gaussian(at, x, sigma) @ w, atol=1e-5)


def test_kernel_limits_and_reports(spark):
    rows = spark.createDataFrame([(i, [0.1 * i], [float(i % 3)]) for i in range(60)], "t long, x array<double>, y array<double>")
    cut = kernel_cg.solve_kernel(rows, 0.05, 1e-6, landmarks=2, tol=1e-14, passes=1)
    assert cut.passes == 1 and cut.residual[0] > 1e-14
    for bad in ({"alpha": 0.0}, {"landmarks": 0}, {"landmarks": 5000}):
        with pytest.raises(ValueError):
            kernel_cg.solve_kernel(rows, **({"sigma": 1.0, "alpha": 1e-3} | bad))
    with pytest.raises(ValueError):
        kernel_cg.solve_kernel(rows.limit(0), 1.0, 1e-3)
    same = rows.withColumn("x", F.array(F.lit(1.0)))  # one point, many times
    assert (kernel_cg.solve_kernel(same, 1.0, 1e-2, landmarks=5).residual < 1e-8).all()


@pytest.mark.parametrize("low,high,sigma", [([0.0], [30.0], 1.0), ([0.0, -1.0], [5.8, 4.0], 1.0), ([-1.0, 0.0, 3.0], [1.0, 1.0, 3.0], 0.9), ([2.0, 2.0], [2.0, 2.0], 0.1)])
def test_features_make_the_kernel_to_rounding(low, high, sigma):
    low, high = np.array(low), np.array(high)
    x = np.vstack((low, high, np.random.default_rng(2).uniform(low, high, (400, len(low)))))
    c = kernel_nodes.node_features(low, high, sigma)(x)
    assert np.abs(c @ c.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * sigma * sigma))).max() < 1e-13
    assert kernel_nodes.node_features(low - 1e3, high + 1e3, sigma) is None and kernel_nodes.node_features(low * np.nan, high, sigma) is None


def folders(spark, name):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-*")
    return len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def test_a_box_of_few_widths_is_solved_without_pairs(spark):
    r = np.random.default_rng(9)
    x, alpha = r.uniform(0, 4, (2500, 2)), 1e-3
    y = np.stack((np.sin(x[:, 0]), r.normal(size=2500)), 1)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t long, x array<double>, y array<double>").repartition(5)
    before = folders(spark, "blocks")
    found = kernel_cg.solve_kernel(rows, 1.0, alpha, landmarks=50, tol=1e-8, block=600)
    assert found.passes <= 2 and (found.residual <= 1e-8).all() and folders(spark, "blocks") == before
    k = kernel_cg.gaussian(x, x, 1.0)
    w = np.linalg.solve(k + alpha * np.eye(2500), y)
    got = np.zeros_like(w)
    for b in found.blocks.collect():
        got[np.frombuffer(b["keys"], "<i8")] = kernel_cg.unpacked(b["p"], 2)
    assert np.linalg.norm((k + alpha * np.eye(2500)) @ got - y) <= 1e-8 * np.linalg.norm(y)
    for at in (x[:60], x[:60] + 3.0):  # the second leaves the box
        points = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(at)], "t long, x array<double>")
        out = np.array([q.y for q in found.evaluate(points).orderBy("t").collect()])
        assert np.allclose(out, kernel_cg.gaussian(at, x, 1.0) @ w, atol=1e-5)


def test_a_pass_over_pairs_leaves_one_state(spark):
    x = np.random.default_rng(1).normal(size=(300, 5))
    rows = spark.createDataFrame([(i, a.tolist(), a[:1].tolist()) for i, a in enumerate(x)], "t long, x array<double>, y array<double>")
    before = folders(spark, "cg"), folders(spark, "blocks")
    found = kernel_cg.solve_kernel(rows, 1.0, 0.1, landmarks=20, block=150)
    assert found.passes > 2 and (folders(spark, "cg"), folders(spark, "blocks")) == (before[0] + 1, before[1])


def test_small_kernel_fits_refer_to_it(spark, monkeypatch):
    monkeypatch.setattr(fit, "MAX_LANDMARKS", 10)
    rows = spark.createDataFrame([(i, [0.1 * i], [0.1]) for i in range(30)], "t long, x array<double>, y array<double>")
    with pytest.raises(ValueError, match="kernel_cg"):
        fit.fit_kernel(rows, 1.0)
