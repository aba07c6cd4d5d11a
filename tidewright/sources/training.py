"""Training tables from the regime catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import dynamics
from tidewright.operators.embedding import delay_embed, snapshot_pairs
from tidewright.sources.simulate import generate_trajectories, rk4


def edmd_training_data(spark: SparkSession, system: str, regime: str, m_train: int = 1000, n_trajectories: int = 10, window: float | Sequence[float] = 1.0, dt: float = 0.01, every: int = 1, center: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """Snapshot pairs (traj_id, t, x, y) of an ensemble around the regime's fixed point."""
    p = dynamics.parameters(system, regime)
    ensemble = generate_trajectories(spark, p, n_trajectories, dt, m_train, every, center or dynamics.fixed_point(p), window, seed)
    return snapshot_pairs(ensemble, ["traj_id"])


def hankel_training_data(spark: SparkSession, system: str, regime: str, m_embed: int = 10, tau: int = 2, m_train: int = 2000, dt: float = 0.01, every: int = 1, x0: Sequence[float] | None = None, observed_state: int = 1) -> tuple[DataFrame, DataFrame]:
    """(series_id, t, value) of one observed coordinate, and its delay vectors (series_id, t, s)."""
    p = dynamics.parameters(system, regime)
    start = list(map(float, x0)) if x0 is not None else [v + 0.1 for v in dynamics.fixed_point(p)]
    starts = spark.createDataFrame([(1, start)], "traj_id long, x0 array<double>")
    series = rk4(starts, p, dt, m_train, every).select(F.col("traj_id").alias("series_id"), "t", F.get("x", F.lit(observed_state - 1)).alias("value"))
    return series, delay_embed(series, m_embed, tau, ["series_id"])
