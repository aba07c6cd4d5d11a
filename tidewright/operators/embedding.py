"""Delay embedding and snapshot pairing.

A series is rows (keys, t, value) with t = 1, 2, ... in each key. Long series are cut into
buckets of consecutive rows; each bucket also gets the few rows before it that its windows
reach (a halo), so that no window has to hold a whole series. Nothing reaches across keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.vectors import as_lists
from tidewright.shared import written

BUCKET = 1 << 16
#: Up to so many delays a window's columns are lags; beyond it, strides of one array a bucket.
FEW_DELAYS = 32
#: Doubles of delay vectors that a task makes at a time.
HELD = 1 << 20


def numbered(df: DataFrame, by: Sequence[str], order: str, tie: str, seconds: int = 86400) -> DataFrame:
    """``df`` with ``t``, the row's 1-based place in its key by (order, tie).

    ``order`` is a timestamp. Rows are counted by time bucket first, and a bucket of over BUCKET
    rows is cut into as many equal spans of time as that takes; a row's place is its place in its
    span plus the counts of earlier ones, so no task sorts a whole series or a crowded day.
    """
    unit = seconds * 1_000_000
    us = F.unix_micros(F.col(order).cast("timestamp"))
    b = df.withColumn("_b", F.floor(us / F.lit(unit)))
    same = lambda cs: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cs]
    sizes = b.groupBy(*by, "_b").agg(F.ceil(F.count("*") / F.lit(BUCKET)).alias("_spans"))
    b = b.alias("l").join(sizes.alias("r"), same([*by, "_b"])).select("l.*", "r._spans")
    b = b.withColumn("_c", F.floor((us - F.col("_b") * unit) * F.col("_spans") / F.lit(unit))).drop("_spans")
    span = [*by, "_b", "_c"]
    counts = b.groupBy(*span).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*span).orderBy(order, tie))
    joined = b.withColumn("_place", place).alias("l").join(counts.alias("r"), same(span))
    return joined.select("l.*", "r._before").withColumn("t", (F.col("_place") + F.col("_before")).cast("long")).drop("_b", "_c", "_place", "_before")


def ranked(df: DataFrame, by: Sequence[str], order: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``t``, the row's 1-based place in its key by ``order`` (a number, unique in its key).

    Rows are dealt by ranges of (key, order), so that one key may hold most of them; a row's place
    is its place in its range plus the counts of earlier ranges of its key. Ranges come from a
    sample and are other ones each time they are evaluated: the dealt rows are written, once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = written(df.repartitionByRange(n, *by, order).withColumn("_r", F.spark_partition_id()), "ranges")
    counts = r.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = r.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(order)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_r"]]
    out = placed.alias("l").join(counts.alias("r"), same).select("l.*", "r._before")
    return out.withColumn("t", (F.col("_place") + F.col("_before")).cast("long")).drop("_r", "_place", "_before")


def haloed(df: DataFrame, by: Sequence[str], before: int, after: int, bucket: int = BUCKET) -> tuple[DataFrame, list[str], Column]:
    """Rows with ``_bucket``, those near an edge in the neighbouring bucket as well; the keys to
    window by; and which rows are a bucket's own. Buckets are no shorter than a window's reach."""
    bucket = max(bucket, before, after)
    own = F.floor((F.col("t") - 1) / F.lit(bucket))
    place = F.pmod(F.col("t") - 1, F.lit(bucket))
    near = [own]
    if before:
        near.append(F.when(place >= bucket - before, own + 1))
    if after:
        near.append(F.when(place < after, own - 1))
    out = df.withColumn("_bucket", F.explode(F.array_compact(F.array(*near)))) if len(near) > 1 else df.withColumn("_bucket", own)
    return out, [*by, "_bucket"], F.col("_bucket") == own


def delay_embed(df: DataFrame, m: int, tau: int, by: Sequence[str] = ("series_id",), value: str = "value", bucket: int = BUCKET) -> DataFrame:
    """(keys, t, s): s[d] is the value d * tau before row t + (m - 1) * tau, the newest first;
    rows without a whole window go. ``value`` may be a number or, for several channels, an
    array: then s is channel after channel.

    Few delays are lags in one window; many are strides of one array a bucket, in Arrow batches of
    about HELD numbers, so that a row's reach is never copied. t counts the delay vectors.
    """
    reach = (m - 1) * tau
    many = dict(df.dtypes)[value].startswith("array")
    rows, keys, own = haloed(df.select(*by, "t", value), by, reach, 0, bucket)
    if m > FEW_DELAYS:
        return strided(rows, keys, by, value, m, tau, max(bucket, reach))
    w = Window.partitionBy(*keys).orderBy("t")
    lags = [F.lag(value, d * tau).over(w) if d else F.col(value) for d in range(m)]
    out = rows.withColumn("_s", F.array(*lags)).withColumn("_ok", F.lag("t", reach).over(w).isNotNull() if reach else F.lit(True))
    s = F.col("_s")
    if many:
        channels = F.sequence(F.lit(0), F.size(F.get(s, F.lit(0))) - 1)
        s = F.flatten(F.transform(channels, lambda c: F.transform(F.col("_s"), lambda v: F.get(v, c))))
    return out.where(own & F.col("_ok")).select(*by, (F.col("t") - reach).alias("t"), s.alias("s"))


def strided(rows: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, m: int, tau: int, bucket: int) -> DataFrame:
    """``delay_embed`` of haloed rows: a row a bucket with its values in order, 2 ``bucket`` at most."""
    types, reach = dict(rows.dtypes), (m - 1) * tau
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", value))).alias("_all"))
    held = held.select(*by, "_bucket", F.col("_all.t").alias("_t"), F.col(f"_all.{value}").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t = batch.column(len(by) + 1)[r].values.to_numpy()
                v = batch.column(len(by) + 2)[r].values
                v = np.array(v.to_pylist(), float) if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False).astype(float)
                v = v.reshape(len(t), -1)
                ends = np.flatnonzero((t - 1) // bucket == batch.column(len(by))[r].as_py())
                ends = ends[ends >= reach]
                delays = tau * np.arange(m)
                step = max(1, HELD // (m * v.shape[1]))
                for a in range(0, len(ends), step):
                    e = ends[a : a + step]
                    s = v[e[:, None] - delays].transpose(0, 2, 1).reshape(len(e), -1)  # channel after channel
                    given = [pa.repeat(batch.column(k)[r], len(e)) for k in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*given, pa.array(t[e] - reach, pa.int64()), as_lists(s)], names=[*by, "t", "s"])

    ddl = "".join(f"{c} {types[c]}, " for c in by) + "t long, s array<double>"
    return held.mapInArrow(run, ddl)


def snapshot_pairs(df: DataFrame, by: Sequence[str] = ("traj_id",), value: str = "x", bucket: int = BUCKET) -> DataFrame:
    """(keys, t, x, y): each row with its successor; a key's last row has none."""
    rows, keys, own = haloed(df.select(*by, "t", F.col(value).alias("x")), by, 0, 1, bucket)
    w = Window.partitionBy(*keys).orderBy("t")
    out = rows.withColumn("y", F.lead("x").over(w)).withColumn("_next", F.lead("t").over(w))
    return out.where(own & F.col("_next").isNotNull()).drop("_next", "_bucket")


def delay_pairs(pairs: DataFrame, m: int, tau: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Snapshot pairs (keys, t, x, y) -> pairs of delay vectors within each key: the series is the
    first x and all y."""
    first = pairs.where(F.col("t") == 1).select(*by, F.lit(1).cast("long").alias("t"), F.col("x").alias("value"))
    series = first.unionByName(pairs.select(*by, (F.col("t") + 1).alias("t"), F.col("y").alias("value")))
    return snapshot_pairs(delay_embed(series, m, tau, by), by, "s")


def forward_embed(df: DataFrame, m: int, tau: int, by: Sequence[str] = ("series_id",), value: str = "value", bucket: int = BUCKET) -> DataFrame:
    """(keys, t, s): s[j] is the value j * tau after row t."""
    reach = (m - 1) * tau
    rows, keys, own = haloed(df.select(*by, "t", value), by, 0, reach, bucket)
    w = Window.partitionBy(*keys).orderBy("t")
    out = rows.withColumn("s", F.array(*[F.lead(value, j * tau).over(w) if j else F.col(value) for j in range(m)]))
    last = F.lead("t", reach).over(w).isNotNull() if reach else F.lit(True)
    return out.withColumn("_ok", last).where(own & F.col("_ok")).select(*by, "t", "s")


def central_difference(df: DataFrame, dt: float, by: Sequence[str] = ("series_id",), value: str = "value", bucket: int = BUCKET) -> DataFrame:
    """(keys, t, derivative) of fourth order, from the third row to the last but two; of an array
    column, an array."""
    rows, keys, own = haloed(df.select(*by, "t", value), by, 2, 2, bucket)
    w = Window.partitionBy(*keys).orderBy("t")
    at = lambda k: F.lag(value, -k).over(w)
    if dict(df.dtypes)[value].startswith("array"):
        near, far = F.zip_with(at(1), at(-1), lambda a, b: 8.0 * (a - b)), F.zip_with(at(-2), at(2), lambda a, b: a - b)
        d = F.zip_with(near, far, lambda a, b: (a + b) / F.lit(12.0 * dt))
    else:
        d = (-at(2) + 8.0 * at(1) - 8.0 * at(-1) + at(-2)) / F.lit(12.0 * dt)
    whole = F.lag("t", 2).over(w).isNotNull() & F.lead("t", 2).over(w).isNotNull()
    return rows.withColumn("derivative", d).withColumn("_ok", whole).where(own & F.col("_ok")).select(*by, "t", "derivative")
