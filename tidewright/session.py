"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans re-split skewed joins and size shuffle partitions from what was written.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, app: str = "tidewright", blas_threads: int = 1, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use ``__`` for a dot. ``blas_threads`` is what NumPy
    may use in each Python worker: executors run a worker for each core."""
    builder = SparkSession.builder.appName(app)
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
        builder = builder.config(f"spark.executorEnv.{name}", str(blas_threads))
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
