"""Standardisation, descriptive aggregates and mutual information."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.vectors import EPS
from tidewright.operators.embedding import haloed, ranked
from tidewright.operators.neighbours import floats, median_distance

#: Points whose pairwise distances give an automatic width, as in the reference; a documented bound.
SIGMA_POINTS = 1000


def state_stats(df: DataFrame, value: str = "x") -> list[tuple[float, float]]:
    """(mean, sample deviation) of each coordinate of an array column; a deviation under EPS
    is 1, and of one row it is NaN. One pass, one row for each coordinate."""
    rows = (
        df.select(F.posexplode(value).alias("dim", "v")).groupBy("dim")
        .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).orderBy("dim").collect()
    )
    out = []
    for r in rows:
        std = float("nan") if r["std"] is None else r["std"]
        out.append((r["mean"], 1.0 if std < EPS else std))
    return out


def apply_norm_stats(df: DataFrame, stats: Sequence[tuple[float, float]], value: str = "x") -> DataFrame:
    scaled = F.array(*[(F.get(value, F.lit(i)) - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(stats)])
    return df.withColumn(value, scaled)


def normalize_states(df: DataFrame, value: str = "x") -> tuple[DataFrame, list[tuple[float, float]]]:
    stats = state_stats(df, value)
    return apply_norm_stats(df, stats, value), stats


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each scalar column by its mean and sample deviation, over all rows."""
    aggregates = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.agg(*aggregates)  # one row
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        s = F.when(F.col(f"_s_{c}") < EPS, 1.0).otherwise(F.coalesce(f"_s_{c}", F.lit(float("nan"))))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / s)
    return out.drop(*stats.columns)


def normalize_vector(df: DataFrame, value: str, by: Sequence[str] = (), lb: float = 0.35) -> DataFrame:
    """((v - min) / (max - min) + lb) / (1 + lb), lb / (1 + lb) where all are equal."""
    limits = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = df.join(limits, list(by)) if by else df.crossJoin(F.broadcast(limits))
    width = F.col("_hi") - F.col("_lo")
    share = F.when(width > 0, (F.col(value) - F.col("_lo")) / width).otherwise(0.0)
    return out.withColumn(value, (share + lb) / (1 + lb)).drop("_lo", "_hi")


def median_sigma(df: DataFrame, value: str = "x", key: str = "t", n_sample: int | None = SIGMA_POINTS, seed: int = 0) -> float:
    """Exact median of the pairwise distances of at most ``n_sample`` rows, all where there are no
    more or it is None; 1.0 for fewer than two rows."""
    points = df.select(F.col(key).alias("key"), floats(df, value).alias("x"))
    if n_sample is not None:
        points = points.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n_sample)
    out = median_distance(points)
    return 1.0 if out is None else out


def mutual_information(df: DataFrame, lags: Sequence[int], by: Sequence[str] = ("series_id",), value: str = "value", n_bins: int = 50) -> DataFrame:
    """(keys, lag, mi) in nats between a series and itself ``lag`` rows later.

    Bins divide the range of the whole series. Lag 0 is NaN; a lag past the end and a constant
    series are 0. All lags share one window; histograms are partial aggregates of at most
    n_bins^2 cells for each key and lag.
    """
    lags = list(lags)
    limits = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    used = [k for k in lags if k > 0]
    reach = max(used, default=0)
    rows, keys, own = haloed(df.select(*by, "t", value), by, 0, reach)
    w = Window.partitionBy(*keys).orderBy("t")
    leads = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(value, k).over(w).alias("later")) for k in used]) if used else F.array()
    pairs = rows.withColumn("_leads", leads).where(own).select(*by, F.col(value).alias("now"), F.explode("_leads").alias("l")) if used else None
    cells = limits.select(*by, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    if pairs is None:
        return cells.select(*by, "lag", F.when(F.col("lag") == 0, F.lit(float("nan"))).otherwise(0.0).alias("mi"))
    pairs = pairs.select(*by, "now", "l.lag", "l.later").where(F.col("later").isNotNull())
    pairs = pairs.join(limits, list(by)) if by else pairs.crossJoin(F.broadcast(limits))  # one row
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    box = lambda v: F.least(F.lit(n_bins), F.floor((v - F.col("_lo")) / width) + 1).cast("int")
    counts = pairs.where("_hi > _lo").groupBy(*by, "lag", box(F.col("now")).alias("a"), box(F.col("later")).alias("b")).agg(F.count("*").alias("n"))
    part = [*by, "lag"]
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*part))
    px = F.sum("n").over(Window.partitionBy(*part, "a")) / F.sum("n").over(Window.partitionBy(*part))
    py = F.sum("n").over(Window.partitionBy(*part, "b")) / F.sum("n").over(Window.partitionBy(*part))
    terms = counts.select(*part, (p * F.log(p / (px * py))).alias("v"))
    found = terms.groupBy(*part).agg(F.sum("v").alias("mi"))
    out = cells.join(found, part, "left")
    return out.select(*part, F.when(F.col("lag") == 0, F.lit(float("nan"))).otherwise(F.coalesce("mi", F.lit(0.0))).alias("mi"))


def find_first_minimum(df: DataFrame, by: Sequence[str] = (), index: str = "i", value: str = "value") -> DataFrame:
    """(keys, i): the first index lower than the one before and no higher than the one after,
    else the first of the smallest."""
    w = Window.partitionBy(*by).orderBy(index)
    dip = (F.col(value) < F.lag(value).over(w)) & (F.col(value) <= F.lead(value).over(w))
    marked = df.withColumn("_dip", dip)
    first, least = F.min(F.when(F.col("_dip"), F.col(index))), F.min_by(index, F.struct(value, index))
    return marked.groupBy(*by).agg(F.coalesce(first, least).alias("i"))


def signed_area(df: DataFrame, by: Sequence[str] = (), order: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """(keys, area) of each polygon by the shoelace sum, the last corner joined to the first.

    Corners are numbered by ranges and meet the next one in buckets; the closing term comes from
    an aggregate. A polygon may hold most of the rows."""
    corners = ranked(df.select(*by, F.col(order).alias("_o"), F.col(x).alias("_x"), F.col(y).alias("_y")), by, "_o")
    rows, keys, own = haloed(corners, by, 0, 1)
    w = Window.partitionBy(*keys).orderBy("t")
    step = rows.withColumn("_term", F.col("_x") * F.lead("_y").over(w) - F.lead("_x").over(w) * F.col("_y")).where(own)
    point = F.struct("_x", "_y")
    sums = step.groupBy(*by).agg(F.coalesce(F.sum("_term"), F.lit(0.0)).alias("_s"), F.min_by(point, "t").alias("_a"), F.max_by(point, "t").alias("_b"))
    closing = F.col("_b._x") * F.col("_a._y") - F.col("_a._x") * F.col("_b._y")
    return sums.select(*by, ((F.col("_s") + closing) / 2).alias("area"))


def select_rank(sigma: Sequence[float], method: str = "energy", energy: float = 0.999, aspect: float = 1.0) -> int:
    """Rank of a descending list of singular values.

    ``energy``: first to reach that share of the squares. ``hard_threshold``: those above a
    multiple of the median, 2 at least. ``gap``: where the log differences are largest, which
    is the smallest drop, 2 at least; ``largest_gap``: the largest drop.
    """
    s = np.asarray(sigma, float)
    if method == "energy":
        share = np.cumsum(s**2) / np.sum(s**2)
        return int(np.argmax(share >= energy)) + 1 if (share >= energy).any() else len(s)
    if method == "hard_threshold":
        b = min(1.0, max(1e-6, aspect))
        omega = 0.56 * b**3 - 0.95 * b**2 + 1.82 * b + 1.43
        return max(2, int((s > omega * np.median(s)).sum()))
    if method in ("gap", "largest_gap"):
        drops = np.diff(np.log(s[s > 0]))
        if not len(drops):
            return 2
        return max(2, int(drops.argmax() if method == "gap" else drops.argmin()) + 1)
    raise ValueError(f"unknown rank method {method!r}")


def rank_by_energy(df: DataFrame, by: Sequence[str] = (), index: str = "k", value: str = "sigma", energy: float = 0.999) -> DataFrame:
    """(keys, rank) by ``energy``, for a table of singular values."""
    w = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    sq = F.col(value) * F.col(value)
    share = df.withColumn("_share", F.sum(sq).over(w) / F.sum(sq).over(whole))
    return share.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_share") >= energy, F.col(index))), F.max(index)).alias("rank"))


def prediction_error(df: DataFrame) -> DataFrame:
    """(step, error) of (start_idx, step, dim, x_true, x_pred): Euclidean over dimensions, mean
    over starts."""
    d = F.col("x_pred") - F.col("x_true")
    per = df.groupBy("start_idx", "step").agg(F.sqrt(F.sum(d * d)).alias("e"))
    return per.groupBy("step").agg(F.avg("e").alias("error"))


def padded_limits(df: DataFrame, value: str = "x", pad: float = 0.1) -> DataFrame:
    """(dim, low, high): the range of each coordinate, widened by ``pad`` of it."""
    r = df.select(F.posexplode(value).alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return r.select("dim", (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("low"), (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("high"))


def phase_of(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def dictionary_size(n: int, degree: int) -> int:
    """Monomials of n variables up to a degree."""
    return math.comb(n + degree, degree)
