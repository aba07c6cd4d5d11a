"""Sums over delay vectors without the delay vectors.

With H[i, j] = sum over t of x(t + i tau) x(t + shift + j tau), the sum for (i + 1, j + 1) runs over
the same products tau rows later: it is H[i, j] without the first tau products and with the tau that
follow. So one row and one column of lagged products, and the few rows at either end of the series,
give the whole matrix. The work on the data is rows times delays, and nothing of a delay vector's
length is made or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import as_lists
from tidewright.operators.embedding import BUCKET, haloed

#: Rows at either end of a series that come to the driver, at most: (delays + 1) * stride + shift.
MAX_EDGE = 1 << 22


def lagged_products(series: DataFrame, asked: Sequence[tuple[Sequence[int], int, int]], value: str = "value", bucket: int = BUCKET) -> list[np.ndarray]:
    """For each (lags, first, last): the sums over first <= t <= last of x(t) x(t + lag), one for
    each lag, all in one pass. Lags are 0 or more, and the series (t, value) holds what they reach.

    A bucket is one array with its halo; a task hands on a number a lag and bucket."""
    asked = [(np.asarray(lags, np.int64), first, last) for lags, first, last in asked]
    reach = max((int(lags.max()) for lags, _, _ in asked if len(lags)), default=0)
    rows, keys, _ = haloed(series.select("t", value), [], 0, reach, bucket)
    bucket = max(bucket, reach)
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", value))).alias("_all"))
    held = held.select("_bucket", F.col("_all.t").alias("t"), F.col(f"_all.{value}").alias("v"))
    count = sum(len(lags) for lags, _, _ in asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, t, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                begin, v = int(t.values[0].as_py()), v.values.to_numpy(zero_copy_only=False).astype(float)
                low, high = b * bucket + 1, (b + 1) * bucket
                sums = []
                for lags, first, last in asked:
                    a, e = max(low, first) - begin, min(high, last) - begin + 1
                    own = v[a:e] if e > a else v[:0]
                    sums += [float(own @ v[a + k : e + k]) if e > a else 0.0 for k in lags]
                yield pa.RecordBatch.from_arrays([as_lists(np.array([sums]))], names=["sums"])

    parts = held.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    got = parts.toArrow()  # a number a lag
    out = np.zeros(count)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return np.split(out, np.cumsum([len(lags) for lags, _, _ in asked])[:-1])


def hankel_gram(series: DataFrame, m: int, tau: int, shift: int = 0, value: str = "value") -> tuple[np.ndarray, int]:
    """(G, n) of one series (t, value), t = 1, 2, ..: G[d, e] is the sum over the n delay vectors s
    (as ``delay_embed`` makes them) that have one ``shift`` rows later of s_t[d] s_(t + shift)[e].

    The driver holds the m x m matrix and the ends of the series."""
    edge = (m - 1) * tau + shift
    if (m + 1) * tau + shift > MAX_EDGE:
        raise ValueError(f"{m} delays of {tau} rows reach over {MAX_EDGE} rows")
    total = series.agg(F.max("t")).first()[0] or 0
    n = total - edge
    if n < 1:
        raise ValueError(f"{total} rows hold no {m} delays of {tau} rows")
    asked = [(shift + tau * np.arange(m), 1, n)]
    if shift:
        if shift > tau:
            raise ValueError("a shift past the stride needs products before their row")
        asked.append((tau * np.arange(1, m) - shift, 1 + shift, n + shift))
    sums = lagged_products(series, asked, value)
    h = np.zeros((m, m))
    h[0], h[1:, 0] = sums[0], sums[-1][1:] if not shift else sums[1]
    if m > 1:
        ends = series.where((F.col("t") <= edge) | (F.col("t") > total - edge)).select("t", F.col(value).cast("double").alias("v")).toArrow()
        x = dict(zip(ends.column("t").to_pylist(), ends.column("v").to_pylist(), strict=True))

        def block(start: int) -> np.ndarray:
            """x(start + i tau + c) for i = 0 .. m - 2 and c = 0 .. tau - 1."""
            return np.array([x[start + k] for k in range((m - 1) * tau)], float).reshape(m - 1, tau)

        change = block(n + 1) @ block(n + 1 + shift).T - block(1) @ block(1 + shift).T
        for k in range(1, m):
            h[k, 1:] = h[k - 1, :-1] + change[k - 1]
    return h[::-1, ::-1].copy(), n


def hankel_axes(series: DataFrame, m: int, tau: int, value: str = "value") -> tuple[np.ndarray, np.ndarray, int]:
    """(U, sigma, n): the principal axes of the delay vectors from their structured sums; sigma below
    about 1e-8 of the largest is noise."""
    from tidewright.operators.fit import signed

    g, n = hankel_gram(series, m, tau, 0, value)
    lam, u = np.linalg.eigh((g + g.T) / 2)
    return signed(u[:, ::-1]), np.sqrt(np.maximum(lam[::-1], 0)), n


def hankel_operator(series: DataFrame, m: int, tau: int, r: int | None = None, alpha: float = 0.0, value: str = "value") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(K, U, sigma) with z <- K z for the r leading coordinates z = U' s of the delay vectors: least
    squares (with a ridge ``alpha``) over all pairs of successors, from the structured sums alone."""
    u, sigma, _ = hankel_axes(series, m, tau, value)
    u, sigma = u[:, :r], sigma[:r]
    ahead, n = hankel_gram(series, m, tau, 1, value)  # sum of s_t s_(t+1)'
    here, _ = hankel_gram(series.where(F.col("t") < F.lit(n + (m - 1) * tau + 1)), m, tau, 0, value)  # the vectors that have a successor
    g = u.T @ ((here + here.T) / 2) @ u + alpha * np.eye(u.shape[1])
    return np.linalg.solve(g, u.T @ ahead @ u).T, u, sigma
