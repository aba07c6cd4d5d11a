"""What the figures show, as tables: drawing them is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import spectral, stats

# The colours of the figures, and the two cycles of tones as red, green, blue.
COLORS = {"primary": "#2d607e", "accent": "#dc6e00", "secondary": "#8faadc", "background": "#fafafa"}
TONES = {
    "blue": [(20, 40, 80), (45, 96, 126), (80, 140, 180), (120, 170, 210), (143, 170, 220), (180, 200, 240), (210, 225, 250), (100, 150, 200)],
    "orange": [(120, 50, 0), (180, 80, 0), (220, 110, 0), (255, 140, 0), (255, 165, 0), (255, 190, 60), (255, 210, 120), (200, 100, 20)],
}


def tones(name: str, count: int = 8) -> list[str]:
    """``count`` colours of a cycle of tones, from its start again after its end."""
    return ["#%02x%02x%02x" % TONES[name][k % len(TONES[name])] for k in range(count)]


def save(figure: DataFrame, save_dir: str, name: str, format: str = "parquet") -> str:
    """Writes a figure's table to ``save_dir/name``, over an earlier one; the path."""
    path = f"{save_dir.rstrip('/')}/{name}"
    figure.write.mode("overwrite").format(format).save(path)
    return path


def projection(trajectories: DataFrame, dims: Sequence[int], key: str = "traj_id", limit: int | None = None) -> DataFrame:
    """(key, t, d1, d2, ..): curves on the chosen coordinates (from 1) of the first trajectories."""
    out = trajectories if limit is None else trajectories.where(F.col(key) <= limit)
    return out.select(key, "t", *[F.get("x", F.lit(d - 1)).alias(f"d{i + 1}") for i, d in enumerate(dims)])


def phase_portrait(trajectories: DataFrame, dims: Sequence[int] = (1, 2), key: str = "traj_id", pad: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(curves, limits); the limits follow the first trajectory."""
    first = trajectories.agg(F.min(key).alias("_first"))
    own = trajectories.join(F.broadcast(first), F.col(key) == F.col("_first"))  # one row
    limits = stats.padded_limits(own, "x", pad).where(F.col("dim").isin([d - 1 for d in dims]))
    return projection(trajectories, dims, key), limits


def all_views(trajectories: DataFrame, key: str = "traj_id") -> dict[str, DataFrame]:
    """The three-dimensional curves and their three projections."""
    return {"xyz": projection(trajectories, (1, 2, 3), key), "xy": projection(trajectories, (1, 2), key), "xz": projection(trajectories, (1, 3), key), "yz": projection(trajectories, (2, 3), key)}


def training_scatter(pairs: DataFrame, dims: Sequence[int] = (1, 2)) -> DataFrame:
    return pairs.select(*[F.get("x", F.lit(d - 1)).alias(f"d{i + 1}") for i, d in enumerate(dims)])


def clustered(spark: SparkSession, pairs: DataFrame, centers: Sequence[Sequence[float]], dims: Sequence[int] = (1, 2)) -> DataFrame:
    """Points and centres with ``kind``."""
    points = training_scatter(pairs, dims).withColumn("kind", F.lit("point"))
    rows = [tuple(float(c[d - 1]) for d in dims) + ("center",) for c in centers]
    return points.unionByName(spark.createDataFrame(rows, ", ".join(f"d{i + 1} double" for i in range(len(dims))) + ", kind string"))


def prediction(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curves by step, error by step)."""
    return pred.select("start_idx", "step", "dim", "x_true", "x_pred"), stats.prediction_error(pred)


def eigenvalues(spectrum: DataFrame, highlight: Sequence[int] = (), pad: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(points with ``highlighted``, limits)."""
    marked = spectrum.select("k", "re", "im", F.col("k").isin(list(highlight)).alias("highlighted") if highlight else F.lit(False).alias("highlighted"))
    return marked, stats.padded_limits(spectrum.select(F.array("re", "im").alias("x")), "x", pad)


def unit_circle(spark: SparkSession, n: int = 200) -> DataFrame:
    a = F.col("id") * (2 * np.pi / n)
    return spark.range(n + 1).select(F.cos(a).alias("re"), F.sin(a).alias("im"))


def eigenfunctions(fields: DataFrame) -> DataFrame:
    """Real parts of fields (.., mode, re, im), each scaled to [0, 1]."""
    return stats.normalize_vector(fields.select(*[c for c in fields.columns if c != "im"]), "re", ["mode"], 0.0)


def phase_amplitude(fields: DataFrame, phase_mode: int, amplitude_mode: int) -> DataFrame:
    """(g1, .., phase, log_amplitude): arg of the one, ln(|.| + 1e-12) of the other."""
    axes = [c for c in fields.columns if c.startswith("g")]
    phase = fields.where(F.col("mode") == phase_mode).select(*axes, F.atan2("im", "re").alias("phase"))
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    amplitude = fields.where(F.col("mode") == amplitude_mode).select(*axes, F.log(size + 1e-12).alias("log_amplitude"))
    return phase.join(amplitude, axes)


def time_series(trajectories: DataFrame, dt: float) -> DataFrame:
    """(.., time, ..) with time = (t - 1) dt."""
    return trajectories.withColumn("time", (F.col("t") - 1) * F.lit(float(dt)))


def harmonic_table(spark: SparkSession, values: Sequence[complex], dt: float) -> DataFrame:
    return spectral.branches_table(spark, spectral.harmonic_branches(values, dt))
