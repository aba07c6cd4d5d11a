"""Embedding diagnostics, small geometry, and the search for zero level sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.lifts import Dictionary
from tidewright.functions.vectors import as_lists, rows_of
from tidewright.operators.embedding import forward_embed
from tidewright.operators.neighbours import nearest_neighbours
from tidewright.operators.sampling import sampled_with_replacement
from tidewright.operators.thinning import thinned
from tidewright.shared import written

def false_nearest_neighbours(series: DataFrame, m: int, tau: int, rtol: float = 10.0, atol: float = 2.0, value: str = "value") -> float:
    """Share of nearest neighbours in m dimensions that the next one drives apart. ``atol`` is
    taken and not used. 1.0 for series without rows or valid neighbours.

    ``series`` is one series (t, value); it keeps t = 1, 2, ...
    """
    whole = written(forward_embed(series, m + 1, tau, [], value), "embedded")  # read five times
    near = nearest_neighbours(whole.select("t", F.slice("s", 1, m).alias("s")))
    last = whole.select("t", F.get("s", F.lit(m)).alias("_next"))
    both = near.join(last, "t").join(last.select(F.col("t").alias("nn"), F.col("_next").alias("_other")), "nn")
    apart = F.abs(F.col("_next") - F.col("_other")) / F.col("distance") > rtol
    out = both.where(F.col("distance") >= 1e-12).agg(F.avg(F.when(apart, 1.0).otherwise(0.0))).first()[0]
    return 1.0 if out is None else float(out)


def classify_fixed_point(re1: Column, im1: Column, re2: Column, im2: Column) -> Column:
    """The kind of a planar fixed point from its two eigenvalues; equal means relatively within
    the square root of the machine's precision."""
    alike = F.abs(re1 - re2) <= F.lit(1.4901161193847656e-08) * F.greatest(F.abs(re1), F.abs(re2))
    kind = (
        F.when(re1 * re2 < 0, "saddle")
        .when((re1 < 0) & (re2 < 0), F.when(alike, "stable node (star/degenerate)").otherwise("stable node"))
        .when((re1 > 0) & (re2 > 0), "unstable node")
        .otherwise("non-hyperbolic")
    )
    turning = F.when(re1 < 0, "stable spiral/focus").when(re1 > 0, "unstable spiral/focus").otherwise("center")
    return F.when((im1 == 0) & (im2 == 0), kind).otherwise(turning)


def meshgrid(spark: SparkSession, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """(i, j, x, y): row i has y[i], column j has x[j], from 1."""
    x = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(xs)], "j int, x double")
    y = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ys)], "i int, y double")
    return y.crossJoin(F.broadcast(x)).select("i", "j", "x", "y")


def jacobian(f: Callable[[np.ndarray], Sequence[float]], x: Sequence[float], h: float = 1e-6) -> np.ndarray:
    """Central differences, (outputs, inputs)."""
    x = np.asarray(x, float)
    columns = []
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = h
        columns.append((np.asarray(f(x + e), float) - np.asarray(f(x - e), float)) / (2 * h))
    return np.array(columns).T


def jacobians(points: DataFrame, f: Callable[[np.ndarray], np.ndarray], keys: Sequence[str], value: str = "x", h: float = 1e-6) -> DataFrame:
    """(keys, i, j, value) of every row's Jacobian by central differences (output i, input j, from 1);
    ``f`` takes a batch of states, a row each."""
    types, keys = dict(points.dtypes), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                x = rows_of(b.column(len(keys)))
                n, dim = x.shape
                steps = h * np.eye(dim)
                d = np.stack([(f(x + e) - f(x - e)) / (2 * h) for e in steps], 2)
                given = [c.take(pa.array(np.repeat(np.arange(n), d[0].size))) for c in b.columns[: len(keys)]]
                i, j = (np.tile(v.ravel() + 1, n).astype(np.int32) for v in np.indices(d.shape[1:]))
                yield pa.RecordBatch.from_arrays([*given, pa.array(i), pa.array(j), pa.array(d.ravel())], names=[*keys, "i", "j", "value"])

    return points.select(*keys, value).mapInArrow(run, "".join(f"{k} {types[k]}, " for k in keys) + "i int, j int, value double")


def grad_phi(d: Dictionary, x: Sequence[float], xi: np.ndarray) -> np.ndarray:
    """Gradient of Re(psi' xi) at one state, by the dictionary's own derivative."""
    return np.real(d.gradient(np.asarray(x, float)) @ xi)


def zero_level_points(points: DataFrame, d: Dictionary, vectors: np.ndarray, modes: Sequence[int], n_starts: int | None = 500, n_iter: int = 200, rate: float = 0.1, tol: float = 1e-8, seed: int = 0, key: str = "t", value: str = "x", apart: float = 0.05) -> DataFrame:
    """(start, x, objective, converged): points where the real parts of the chosen modes (from 1)
    vanish, by gradient descent with Armijo steps from ``n_starts`` rows drawn with replacement, in
    the order of ``key`` (a number, unique); start is the draw's number. None starts from every row
    once, and start is its key.

    Each start is its own; those that converge within ``apart`` of an earlier one that stays go.
    """
    xi = vectors[:, [m - 1 for m in modes]]
    states = points.select(F.col(key).cast("long").alias("start"), F.col(value).cast("array<double>").alias("x"))
    starts = states if n_starts is None else sampled_with_replacement(states, n_starts, "start", seed).select(F.col("draw").alias("start"), "x")
    some = np.array([r["x"] for r in starts.orderBy("start").limit(200).collect()], float)
    ddl = "start long, x array<double>, objective double, converged boolean"
    if not len(some):
        return points.sparkSession.createDataFrame([], ddl)
    scale = float(((d.batch(some) @ xi).real ** 2).sum(1).mean()) + 1e-12

    def values(x: np.ndarray) -> np.ndarray:
        return ((d.batch(x) @ xi).real ** 2).sum(1)

    def slopes(x: np.ndarray) -> np.ndarray:
        phi = (d.batch(x) @ xi).real
        return np.array([2 * np.real(d.gradient(row) @ xi) @ p for row, p in zip(x, phi, strict=True)])

    def descend(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A batch of starts moves together; each has a step of its own."""
        x, f = x.copy(), values(x)
        moving = np.arange(len(x))
        for _ in range(n_iter):
            g = slopes(x[moving]) if len(moving) else np.zeros((0, x.shape[1]))
            size = np.linalg.norm(g, axis=1)
            on = ~((size < tol) | (f[moving] < 1e-12 * scale))
            moving, g, size = moving[on], g[on], size[on]
            if not len(moving):
                break
            step, left = np.maximum(rate, 1 / size), np.arange(len(moving))
            new, at = x[moving] - (0.01 / size)[:, None] * g, None
            for _ in range(30):
                trial = x[moving[left]] - step[left, None] * g[left]
                at = values(trial)
                fits = at <= f[moving[left]] - 1e-4 * step[left] * size[left] ** 2
                new[left[fits]] = trial[fits]
                left = left[~fits]
                if not len(left):
                    break
                step[left] /= 2
            x[moving], f[moving] = new, values(new)
        return x, f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                x, f = descend(rows_of(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), as_lists(x), pa.array(f), pa.array(f < 1e-6 * scale)], names=["start", "x", "objective", "converged"])

    # a descent is long and a row short
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(starts.repartition(tasks, "start").mapInArrow(run, ddl), "descended").where("converged")
    return thinned(found, apart, "start", "x")
