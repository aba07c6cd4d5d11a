import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import krylov, spectral


def entries(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a) + 1, int(b) + 1, float(m[a, b])) for a, b in zip(i, j, strict=True)], "i int, j int, value double").repartition(3)


def planted(n, seed=0):
    """A sparse matrix with ten known leading eigenvalues, two pairs among them, and small others."""
    r = np.random.default_rng(seed)
    d = np.diag(r.uniform(-0.5, 0.5, n))
    for a, (re, im) in enumerate(((0.9, 0.3), (0.6, 0.6))):
        d[2 * a : 2 * a + 2, 2 * a : 2 * a + 2] = [[re, im], [-im, re]]
    d[range(4, 10), range(4, 10)] = [1.0, -0.98, 0.97, 0.8, 0.75, -0.7]
    half, e = n // 2, np.zeros((n, n))
    e[np.repeat(np.arange(half), 20), r.integers(half, n, 20 * half)] = r.normal(size=20 * half) * 0.2
    return d + e * np.diag(d) - d @ e  # (1 + e) d (1 - e), e times d times e being 0


@pytest.mark.parametrize("symmetric", [False, True])
@pytest.mark.parametrize("n, howmany, space", [(60, 5, 60), (300, 10, 60), (300, 7, 20)])
def test_leading_pairs_of_random_matrices(n, howmany, space, symmetric):
    k = np.random.default_rng(n).normal(size=(n, n)) / np.sqrt(n)
    k = (k + k.T) / 2 if symmetric else k
    found = spectral.leading_eigenpairs(lambda v: k @ v, n, howmany, space)
    want = spectral.eigendecomposition(k)[0]
    assert found.converged and found.residuals.max() < 1e-8
    assert np.abs(found.values[:, None] - want[None]).min(1).max() < 1e-7
    assert np.allclose(np.linalg.norm(found.vectors, axis=0), 1)
    if symmetric:
        assert np.allclose(np.abs(found.values), np.abs(want[:howmany]), atol=1e-8)


def test_repeated_values_zero_operators_and_low_rank():
    d = np.diag([1.0] * 30 + [0.5] * 70)
    found = spectral.leading_eigenpairs(lambda v: d @ v, 100, 32, 50)
    assert found.converged and np.allclose(found.values.real, [1.0] * 30 + [0.5] * 2)
    assert np.linalg.matrix_rank(found.vectors) == 32
    zero = spectral.leading_eigenpairs(lambda v: 0 * v, 50, 5, 20)
    assert zero.converged and not zero.values.any()
    r = np.random.default_rng(2)
    low = r.normal(size=(200, 3)) @ r.normal(size=(3, 200)) / 200
    found = spectral.leading_eigenpairs(lambda v: low @ v, 200, 6, 30)
    assert np.allclose(found.values[:3], spectral.eigendecomposition(low)[0][:3]) and np.abs(found.values[3:]).max() < 1e-12
    assert np.allclose(spectral.leading_eigenpairs(lambda v: 2 * v, 1, 3).values, [2])


def test_one_factorisation_is_not_enough_here():
    n = 1500
    d = np.linspace(0.9, 1, n)  # a spectrum without gaps
    found = spectral.leading_eigenpairs(lambda v: d[:, None] * v, n, 4, 40)
    assert found.converged and found.products * 8 > 3 * 40
    assert np.allclose(found.values.real, d[::-1][:4], atol=1e-9)


def test_row_blocks_multiply_as_the_matrix(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(700, 700)) * (r.random((700, 700)) < 0.02)
    m[280:480] = r.normal(size=(200, 700))  # some blocks are dense
    m[256:270] = 0
    op = krylov.row_blocks(entries(spark, m), 700)
    kinds = {row.dense for row in op.blocks.select(F.col("i").isNull().alias("dense")).collect()}
    assert kinds == {False, True}
    x = r.normal(size=(700, 5))
    assert np.allclose(op.times(x), m @ x)
    op.release()


def test_entries_add_up_and_have_to_lie_inside(spark):
    rows = [(1, 1, 2.0), (1, 1, 0.5), (3, 2, None), (2, 3, 4.0)]
    op = krylov.row_blocks(spark.createDataFrame(rows, "i int, j int, value double"), 3)
    assert np.allclose(op.times(np.eye(3)), [[2.5, 0, 0], [0, 0, 4], [0, 0, 0]])
    empty = krylov.row_blocks(spark.createDataFrame([], "i int, j int, value double"), 3)
    assert not empty.leading(2).values.any()
    for bad in ((0, 1), (1, 4), (None, 1)):
        with pytest.raises(Exception, match="outside"):
            krylov.row_blocks(spark.createDataFrame([(*bad, 1.0)], "i int, j int, value double"), 3)
    with pytest.raises(ValueError):
        op.leading(1, krylov=1 << 30)


def test_spectrum_of_a_table_of_4000_features(spark, tmp_path):
    n = 4000
    m = planted(n)
    entries(spark, m).write.parquet(f"{tmp_path}/operator.parquet")
    op = krylov.row_blocks(spark.read.parquet(f"{tmp_path}/operator.parquet"), n)
    found = op.leading(10, krylov=80)
    op.release()
    assert found.converged and found.residuals.max() < 1e-8
    want = [1.0, -0.98, 0.97, 0.9 + 0.3j, 0.9 - 0.3j, 0.6 + 0.6j, 0.6 - 0.6j, 0.8, 0.75, -0.7]
    assert np.allclose(found.values, sorted(want, key=lambda v: (-abs(v), -v.imag)), atol=1e-8)
    assert np.abs(m @ found.vectors - found.vectors * found.values).max() < 1e-8


def test_walk_on_a_ring(spark):
    steps = spark.createDataFrame([(1,), (1,), (-2,), (13,), (None,)], "step long")
    op = krylov.row_blocks(krylov.step_operator(steps, 7), 7)
    want = np.zeros((7, 7))
    for at in range(7):
        for s in (1, 1, 5, 6):
            want[at, (at + s) % 7] += 0.25
    assert np.allclose(op.times(np.eye(7)), want)
