"""Trajectories: fixed-step Runge-Kutta and Euler-Maruyama over tables of initial states.

A task integrates all trajectories of an Arrow batch at once and emits them in time blocks,
so memory follows the batch, not the horizon. Random numbers depend on the seed, the
trajectory and the step only, never on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.dynamics import Parameters
from tidewright.functions.vectors import as_lists, rows_of

#: Trajectories that a task moves forward together, and snapshots that it holds of each.
TOGETHER, HELD = 256, 256
TRAJECTORY = "traj_id long, t long, x array<double>"

Field = Callable[[np.ndarray], np.ndarray]


def field_of(rhs: Parameters | Field) -> Field:
    """A vector field on (n, k) arrays, a column a trajectory."""
    return (lambda x: np.stack(rhs.drift(list(x)))) if isinstance(rhs, Parameters) else rhs


def rk4_step(f: Field, x: np.ndarray, h: float) -> np.ndarray:
    k1 = f(x)
    k2 = f(x + h / 2 * k1)
    k3 = f(x + h / 2 * k2)
    k4 = f(x + h * k3)
    return x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def snapshots(batches: Iterator[pa.RecordBatch], step: Callable, m: int, every: int) -> Iterator[pa.RecordBatch]:
    """Batches of (traj_id, x0) -> (traj_id, t, x) at t = 1 .. m + 1, ``every`` steps apart."""
    for whole in batches:
        for at in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(at, TOGETHER)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = rows_of(batch.column(1)).T.copy()
            held, first, n = [x], 1, 0
            for t in range(2, m + 2):
                for _ in range(every):
                    x = step(x, ids, n)
                    n += 1
                held.append(x)
                if len(held) == HELD:
                    yield pack(ids, first, held)
                    held, first = [], t + 1
            if held:
                yield pack(ids, first, held)


def pack(ids: np.ndarray, first: int, held: list[np.ndarray]) -> pa.RecordBatch:
    cube = np.stack(held).transpose(2, 0, 1)  # trajectory, time, coordinate
    k, steps, n = cube.shape
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, steps)), pa.array(np.tile(np.arange(first, first + steps), k)), as_lists(cube.reshape(k * steps, n))],
        names=["traj_id", "t", "x"],
    )


def rk4(starts: DataFrame, rhs: Parameters | Field, dt: float, m: int, every: int = 1) -> DataFrame:
    """(traj_id, t, x) from (traj_id, x0): m + 1 snapshots, ``every`` steps of ``dt`` apart."""
    if dt <= 0:
        raise ValueError("dt has to be positive")
    f = field_of(rhs)
    run = lambda batches: snapshots(batches, lambda x, ids, n: rk4_step(f, x, dt), m, every)
    return starts.select(F.col("traj_id").cast("long"), "x0").mapInArrow(run, TRAJECTORY)


def evaluated(df: DataFrame, p: Parameters, keys: Sequence[str], value: str = "x") -> DataFrame:
    """(keys, f, g): drift and diffusion at every row's state, in Arrow batches. For long right-hand
    sides, whose columns would make a large plan."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = list(rows_of(b.column(len(keys))).T)
                parts = [as_lists(np.stack(v).T) for v in (p.drift(x), p.diffusion(x))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *parts], names=[*keys, "f", "g"])

    return df.select(*keys, value).mapInArrow(run, "".join(f"{k} {types[k]}, " for k in keys) + "f array<double>, g array<double>")


def normals(seed: int, ids: np.ndarray, step: int, dim: int) -> np.ndarray:
    """Standard normals (dim, trajectories) from a counter: a hash of seed, trajectory, step and
    coordinate gives two uniforms, and these a normal (Box-Muller)."""
    with np.errstate(over="ignore"):
        key = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        u = []
        for c in range(2 * dim):
            z = key + np.uint64(c + 1) * np.uint64(0x8CB92BA72F3D8DD7)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            u.append(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53)
    u = np.array(u)
    return np.sqrt(-2 * np.log1p(-u[:dim])) * np.cos(2 * np.pi * u[dim:])


def euler_maruyama(starts: DataFrame, drift: Parameters | Field, dt: float, m: int, every: int = 1, seed: int = 0, diffusion: Field | None = None) -> DataFrame:
    """As ``rk4``, for x + f dt + g sqrt(dt) N(0, 1); ``diffusion`` is the parameters' own unless
    given."""
    f = field_of(drift)
    g = diffusion or (lambda x: np.stack(drift.diffusion(list(x))))

    def step(x: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        return x + f(x) * dt + g(x) * np.sqrt(dt) * normals(seed, ids, n, len(x))

    run = lambda batches: snapshots(batches, step, m, every)
    return starts.select(F.col("traj_id").cast("long"), "x0").mapInArrow(run, TRAJECTORY)


def box_starts(spark: SparkSession, n_traj: int, center: Sequence[float], scale: float | Sequence[float] = 1.0, seed: int = 0) -> DataFrame:
    """(traj_id, x0): uniform in the box center +- scale, from 48 bits of the md5 of trajectory,
    seed and coordinate; traj_id from 1."""
    s = [float(scale)] * len(center) if np.isscalar(scale) else list(map(float, scale))
    digest = lambda i: F.md5(F.concat_ws(":", "traj_id", F.lit(int(seed)), F.lit(i)).cast("binary"))
    u = lambda i: (F.conv(F.substring(digest(i), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    x0 = F.array(*[F.lit(float(c)) + F.lit(w) * (2 * u(i) - 1) for i, (c, w) in enumerate(zip(center, s, strict=True))])
    return spark.range(1, n_traj + 1).select(F.col("id").alias("traj_id")).withColumn("x0", x0)


def generate_trajectories(spark: SparkSession, rhs: Parameters | Field, n_traj: int, dt: float, m: int, every: int = 1, center: Sequence[float] | None = None, scale: float | Sequence[float] = 1.0, seed: int = 0) -> DataFrame:
    """An ensemble from random starts; without a center, around 0 in the system's dimension."""
    if center is None:
        center = [0.0] * (rhs.dim if isinstance(rhs, Parameters) else 2)
    return rk4(box_starts(spark, n_traj, center, scale, seed), rhs, dt, m, every)


def generate_test_trajectories(spark: SparkSession, rhs: Parameters | Field, n_traj: int, dt: float, top: int, every: int = 1, center: Sequence[float] | None = None, window: float | Sequence[float] = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(test trajectories, their starts)."""
    center = center if center is not None else [0.0] * (rhs.dim if isinstance(rhs, Parameters) else 2)
    starts = box_starts(spark, n_traj, center, window, seed)
    return rk4(starts, rhs, dt, top, every), starts


def detect_limit_cycle(spark: SparkSession, rhs: Parameters | Field, dt: float, transient: int, cycle: int, every: int = 1, x0: Sequence[float] | None = None) -> DataFrame:
    """The part of a trajectory from snapshot ``transient`` on: cycle + 2 snapshots."""
    x0 = list(map(float, x0)) if x0 is not None else [0.1] * (rhs.dim if isinstance(rhs, Parameters) else 2)
    start = spark.createDataFrame([(1, x0)], "traj_id long, x0 array<double>")
    return rk4(start, rhs, dt, transient + cycle, every).where(F.col("t") >= transient)
