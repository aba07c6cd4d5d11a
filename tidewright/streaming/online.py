"""Fits that follow a stream: the sums of a ridge fit are additive, so each micro-batch adds
its own and a new operator is solved from the running total.

Each batch's sums are written under its batch id before they count, so that a batch that is
run again after a failure replaces its own part and is never counted twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.lifts import Dictionary
from tidewright.operators.fit import dense, gram, lifted_pairs

CELLS = "batch_id long, block string, i int, j int, value double"


def add_batch(pairs: DataFrame, batch_id: int, d: Dictionary, path: str) -> None:
    """Writes the sums of one micro-batch of snapshot pairs (x, y), for ``foreachBatch``."""
    lifted = lifted_pairs(pairs.select("x", "y"), d)
    size = (d.size, d.size)
    parts = [gram(lifted, (), "psi_x", c, size).withColumn("block", F.lit(b)) for b, c in (("G", "psi_x"), ("A", "psi_y"))]
    cells = parts[0].unionByName(parts[1]).withColumn("batch_id", F.lit(batch_id).cast("long"))
    cells = cells.select("block", F.col("i").cast("int"), F.col("j").cast("int"), "value")
    cells.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(pairs: DataFrame, d: Dictionary, path: str, checkpoint: str, **options):
    """A running query that keeps the sums of a stream of snapshot pairs under ``path``."""
    writer = pairs.writeStream.foreachBatch(lambda df, i: add_batch(df, i, d, path)).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.trigger(**{k: v})
    return writer.start()


def current(spark: SparkSession, path: str, size: int, alpha: float = 1e-3) -> np.ndarray:
    """The operator from all batches written so far."""
    cells = spark.read.schema(CELLS).parquet(path).groupBy("block", "i", "j").agg(F.sum("value").alias("value"))
    g, a = (dense(cells.where(F.col("block") == b), (size, size)) for b in "GA")
    return np.linalg.solve(g + alpha * np.eye(size), a)
