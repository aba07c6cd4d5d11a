"""Multi-step prediction: (start_idx, step, dim, x_true, x_pred).

Where the recursion is linear, its rows B (K')^k are computed once on the driver; a
prediction is then a join of starts, steps and truth, and a dot product. Where every step
lifts again, a task moves a batch of starts forward together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import dot, rows_of
from tidewright.operators.embedding import haloed
from tidewright.sources.simulate import Field, field_of, rk4_step

#: Bytes of the rows B (K')^k, at most: they are broadcast.
MAX_POWERS = 1 << 28
RESULT = "start_idx long, step int, dim int, x_true double, x_pred double"


def powers_table(spark, first: np.ndarray, step: np.ndarray, n_pred: int) -> DataFrame:
    """(step, dim, row): rows of first @ step^k, k = 0 .. n_pred."""
    rows, m = [], np.asarray(first, float)
    if m.size * (n_pred + 1) * 8 > MAX_POWERS:
        raise ValueError(f"{n_pred} steps of {m.shape} make over {MAX_POWERS} bytes of rows")
    for k in range(n_pred + 1):
        rows += [(k, i + 1, [float(v) for v in r]) for i, r in enumerate(m)]
        m = m @ step
    return spark.createDataFrame(rows, "step int, dim int, row array<double>")


def linear_rollout(states: DataFrame, starts: Sequence[int] | None, first: np.ndarray, step: np.ndarray, n_pred: int, truth: str = "x", state: str = "psi", true_start: bool = False) -> DataFrame:
    """States (t, state, truth array): predictions from each start, beside the truth ``step`` rows
    later. ``true_start``: step 0 is the truth itself. Starts too near the end are refused; None
    starts from every row that has ``n_pred`` rows after it."""
    spark = states.sparkSession
    last = states.agg(F.max("t")).first()[0] or 0
    if starts and max(starts) + n_pred > last:
        raise ValueError("a start is too near the end")
    rows = powers_table(spark, first, step, n_pred)
    chosen = states.where(F.col("t") <= last - n_pred if starts is None else F.col("t").isin(list(map(int, starts)))).select(F.col("t").alias("start_idx"), F.col(state).alias("_s"))
    out = chosen.crossJoin(F.broadcast(rows)).select("start_idx", "step", "dim", dot(F.col("row"), F.col("_s")).alias("x_pred"), (F.col("start_idx") + F.col("step")).alias("t"))
    true = states.select("t", F.posexplode(truth).alias("_d", "x_true")).select("t", (F.col("_d") + 1).alias("dim"), "x_true")
    true = true.where(F.col("dim") <= len(first))
    out = out.join(true, ["t", "dim"])
    pred = F.when(F.col("step") == 0, F.col("x_true")).otherwise(F.col("x_pred")) if true_start else F.col("x_pred")
    return out.select("start_idx", "step", F.col("dim").cast("int").alias("dim"), "x_true", pred.alias("x_pred"))


def predict_from_psi(states: DataFrame, k: np.ndarray, b: np.ndarray, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
    """Delay vectors with features (t, s, psi): the observable (B psi)[1], step 0 reconstructed."""
    return linear_rollout(states, starts, b[:1], k.T, n_pred, "s", "psi")


def predict_delay_space(states: DataFrame, k: np.ndarray, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
    """s <- K s on (t, s); step 0 is the truth."""
    first = np.zeros((1, len(k)))
    first[0, 0] = 1
    return linear_rollout(states, starts, first, k, n_pred, "s", "s", True)


def predict_states_from_psi(states: DataFrame, k: np.ndarray, b: np.ndarray, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
    """All coordinates of (t, x, psi), lifted once; step 0 is B psi."""
    return linear_rollout(states, starts, b, k.T, n_pred, "x", "psi")


def relifted(starts: DataFrame, move: Callable[[np.ndarray], np.ndarray], read: Callable[[np.ndarray], np.ndarray], n_pred: int, truth: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(start_idx, x) moved forward ``n_pred`` times. ``truth`` moves the true states, or the
    truth is joined later and x_true is null. Step 0 is the truth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = rows_of(batch.column(1))
                true = x.copy()
                for k in range(n_pred + 1):
                    seen, real = read(x), read(true)
                    n, dims = seen.shape
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids, dims), pa.int64()), pa.array(np.full(n * dims, k), pa.int32()), pa.array(np.tile(np.arange(1, dims + 1), n), pa.int32()),
                            pa.array(real.ravel()) if truth or k == 0 else pa.nulls(n * dims, pa.float64()), pa.array(seen.ravel()),
                        ],
                        names=["start_idx", "step", "dim", "x_true", "x_pred"],
                    )
                    x, true = move(x), truth(true) if truth else true

    return starts.select(F.col("start_idx").cast("long"), "x").mapInArrow(run, RESULT)


def predict_states(starts: DataFrame, rhs, k: np.ndarray, d, b: np.ndarray, dt: float, n_pred: int, every: int = 1) -> DataFrame:
    """(start_idx, x): each step lifts again; the truth is integrated beside it."""
    f: Field = field_of(rhs)

    def truth(x: np.ndarray) -> np.ndarray:
        for _ in range(every):
            x = rk4_step(f, x.T, dt).T
        return x

    return relifted(starts, lambda x: d.batch(x) @ k @ b.T, lambda x: x, n_pred, truth)


#: Numbers of states that a bucket of roll-outs holds; starts that move together.
HELD, TOGETHER = 1 << 20, 1024


def rolled_out(states: DataFrame, starts: Sequence[int] | None, n_pred: int, path: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]], bucket: int | None = None) -> DataFrame:
    """Predictions of the observable s[0] of states (t, s), t = 1, 2, .., from each start, or None
    from every row that has ``n_pred`` rows after it; a start too near the end is refused.

    Rows are dealt into buckets with a halo of ``n_pred`` rows after them, so that truth and forcing
    are where the prediction is made. ``path`` gets a bucket's states and the places of some starts in
    them and yields their predictions at step 1, 2, ..; step 0 is the truth."""
    spark = states.sparkSession
    last = states.agg(F.max("t")).first()[0] or 0
    if starts is not None and len(starts) and max(starts) + n_pred > last:
        raise ValueError("a start is too near the end")
    rows = states.select("t", "s")
    asked = None
    if starts is not None:
        asked = np.unique(np.asarray(starts, np.int64))
        needed = spark.createDataFrame([(int(t),) for t in asked], "_t long").select(F.explode(F.sequence(F.col("_t"), F.col("_t") + n_pred)).alias("t")).distinct()
        rows = rows.join(needed, "t", "left_semi")
    if bucket is None:
        first = states.select(F.size("s")).first()
        bucket = max(1, HELD // max(1, first[0] if first else 1))
    bucket = max(bucket, n_pred)
    rows, keys, _ = haloed(rows, [], 0, n_pred, bucket)
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("_all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ts, ss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                t, s = ts.values.to_numpy(), rows_of(ss.values)
                mine = ((t - 1) // bucket == b) & (t <= last - n_pred)
                if asked is not None:
                    mine &= np.isin(t, asked)
                places = np.flatnonzero(mine)
                for a in range(0, len(places), TOGETHER):
                    at = places[a : a + TOGETHER]
                    moving = path(s, at)
                    for k in range(n_pred + 1):
                        true = s[at + k, 0]
                        seen = true if k == 0 else next(moving)
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t[at]), pa.array(np.full(n, k, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(true), pa.array(np.ascontiguousarray(seen))],
                            names=["start_idx", "step", "dim", "x_true", "x_pred"],
                        )

    return held.select("_bucket", F.col("_all.t").alias("t"), F.col("_all.s").alias("s")).mapInArrow(run, RESULT)


def moved_by(move: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]:
    def path(s: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        x = s[at]
        while True:
            x = move(x)
            yield x[:, 0]

    return path


def predict_delay_edmd(states: DataFrame, k: np.ndarray, b_full: np.ndarray, u: np.ndarray, d, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
    """s -> U's -> lift -> K' -> B, every step; step 0 is the truth."""
    return rolled_out(states, starts, n_pred, moved_by(lambda s: d.batch(s @ u) @ k @ b_full.T))


def predict_kernel(states: DataFrame, fit, u: np.ndarray, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
    """The same with the kernel vector as features; ``fit`` is a KernelFit on U's. Its operator is
    (K_xx + alpha I)^-1 K_xy and acts transposed, as every other fit's does; with these Gram
    matrices that moves a state against time."""

    def move(s: np.ndarray) -> np.ndarray:
        x = s @ u
        d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ fit.landmarks.T + (fit.landmarks**2).sum(1)[None], 0)
        return np.exp(-d2 / (2 * fit.sigma**2)) @ fit.k @ fit.b.T @ u.T

    return rolled_out(states, starts, n_pred, moved_by(move))


def predict_forced(states: DataFrame, a: np.ndarray, b: np.ndarray, u: np.ndarray, starts: Sequence[int] | None, n_pred: int, dt: float, use_true_forcing: bool = True) -> DataFrame:
    """v' = A v + B f by Runge-Kutta in the coordinates U's; the forcing f is the true last
    coordinate (its mean at midpoints), or that of the start held still."""
    r = a.shape[0]

    def path(s: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        low, high = at.min(), at.max() + n_pred + 1
        w = s[low:high] @ u
        at = at - low
        v, forcing = w[at, :r], w[:, r]
        rate = lambda y, g: y @ a.T + g[:, None] * b
        for k in range(n_pred):
            f0, f1 = (forcing[at + k + e] if use_true_forcing else forcing[at] for e in (0, 1))
            mid = (f0 + f1) / 2
            k1 = rate(v, f0)
            k2 = rate(v + dt / 2 * k1, mid)
            k3 = rate(v + dt / 2 * k2, mid)
            k4 = rate(v + dt * k3, f1)
            v = v + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
            yield v @ u[0, :r] + f1 * u[0, r]

    return rolled_out(states, starts, n_pred, path)
