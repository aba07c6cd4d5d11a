"""Expressions on ``array<double>`` columns, and tables for small matrices.

Samples are rows, coordinates are array entries. Spark has no complex type: a complex value
is a pair of DOUBLE columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below this a spread counts as none.
EPS = float(np.finfo(np.float64).eps)


def literal(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def entry(a: Column, i: int) -> Column:
    """Entry ``i`` of an array, from 0; null beyond its end."""
    return F.get(a, F.lit(i))


def gaussian(a: Column, b: Column, sigma: float) -> Column:
    """exp(-|a - b|^2 / 2 sigma^2)."""
    return F.exp(-squared_distance(a, b) / F.lit(2.0 * sigma * sigma))


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def as_lists(m: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow column of lists, a row each."""
    m = np.ascontiguousarray(m, np.float64)
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def matrix_table(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """(i, j, value), from 1, of a matrix small enough for the driver."""
    rows = [(i + 1, j + 1, float(v)) for i, row in enumerate(np.asarray(m, float)) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, value double")


def spectrum_table(spark: SparkSession, values: Sequence[complex], vectors: np.ndarray | None = None) -> DataFrame:
    """(k, re, im) and, with eigenvectors, xi_re and xi_im; k from 1."""
    rows = []
    for k, v in enumerate(values):
        row = (k + 1, float(np.real(v)), float(np.imag(v)))
        if vectors is not None:
            row += ([float(x) for x in vectors[:, k].real], [float(x) for x in vectors[:, k].imag])
        rows.append(row)
    return spark.createDataFrame(rows, "k int, re double, im double" + (", xi_re array<double>, xi_im array<double>" if vectors is not None else ""))


def from_matrix_table(df: DataFrame) -> np.ndarray:
    """The dense matrix of a small (i, j, value) table."""
    rows = df.select("i", "j", "value").collect()
    out = np.zeros((max((r.i for r in rows), default=0), max((r.j for r in rows), default=0)))
    for r in rows:
        out[r.i - 1, r.j - 1] = r.value
    return out
