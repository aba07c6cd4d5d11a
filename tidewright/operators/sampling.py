"""Sampling with replacement: the same draws for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.embedding import ranked


def counted_uniform(n: Column, seed: int, salt: str = "draw") -> Column:
    """A number in (0, 1) for each count n: 48 bits of the md5 of n, seed and salt."""
    digest = F.md5(F.concat(n.cast("string"), F.lit(f":{seed}:{salt}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sampled_with_replacement(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """``df`` with ``draw``: draw k = 1 .. n takes row floor(u_k N) + 1 of the N rows in the order of
    ``order`` (a number, unique, without nulls), u_k a counted random number.

    Rows are numbered by ranges and counted ranges, and a draw meets its row by that number, so
    neither depends on how rows are partitioned. No rows give no draws."""
    rows = ranked(df, [], order)
    total = rows.agg(F.count("*")).first()[0]
    if not total:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"))
    place = F.least(F.floor(counted_uniform(F.col("draw"), seed) * float(total)) + 1, F.lit(total)).cast("long")
    return rows.join(draws.withColumn("t", place), "t").drop("t")
