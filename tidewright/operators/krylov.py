"""Leading spectra of operators that lie in tables: products with row blocks as Spark jobs.

The operator never reaches the driver. A block of vectors goes to the tasks, each task multiplies the
row blocks that it reads, and the products come back as Arrow rows; the driver keeps the Krylov basis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.spectral import Leading, leading_eigenpairs
from tidewright.shared import remove, write_once

#: Entries of a row block, at most (but one whole row), and its rows.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 21, 256
#: Bytes of a block of vectors that goes to each executor, and of the basis on the driver, at most.
MAX_VECTORS, MAX_BASIS = 64 << 20, 2 << 30


@dataclass
class RowBlocks:
    """An n x n operator as rows (first, rows, i, j, v): the entries of some consecutive rows, with i and j
    null where ``v`` holds every entry."""

    blocks: DataFrame
    n: int
    path: str

    def times(self, x: np.ndarray) -> np.ndarray:
        """The operator times n x width numbers, in one job."""
        n, width = self.n, x.shape[1]
        if x.nbytes > MAX_VECTORS:
            raise ValueError(f"{width} vectors of {n} numbers are over MAX_VECTORS bytes")
        sent = self.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(x, np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    first, rows = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    i, j, v = (np.frombuffer(c[row].as_buffer(), kind) if c[row].is_valid else None for c, kind in zip(batch.columns[2:], ("<i4", "<i4", "<f8"), strict=True))
                    if i is None:
                        y = v.reshape(rows, n) @ x
                    else:  # entries lie in the order of rows
                        y, starts = np.zeros((rows, width)), np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                        for c in range(width):
                            y[i[starts], c] = np.add.reduceat(v * x[j, c], starts)
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["first", "y"])

        got = self.blocks.mapInArrow(run, "first int, y binary").toArrow()
        sent.destroy()
        out = np.zeros((n, width))
        for first, y in zip(got.column(0).to_pylist(), got.column(1), strict=True):
            part = np.frombuffer(y.as_buffer(), "<f8").reshape(-1, width)
            out[first : first + len(part)] = part
        return out

    def leading(self, howmany: int = 200, krylov: int = 300, width: int = 8, tol: float = 1e-9, restarts: int = 200, seed: int = 0) -> Leading:
        """The ``howmany`` largest eigenpairs; see ``leading_eigenpairs``. Operators so large that a block
        of ``width`` vectors is over MAX_VECTORS take fewer at a time."""
        width = max(1, min(width, MAX_VECTORS // (8 * self.n)))
        if 8 * self.n * (max(krylov, 2 * howmany + 4 * width) + width) > MAX_BASIS:
            raise ValueError("the Krylov basis is over MAX_BASIS bytes; lower krylov or howmany")
        return leading_eigenpairs(self.times, self.n, howmany, krylov, width, tol, restarts, seed)

    def release(self) -> None:
        """Removes the written blocks."""
        remove(self.blocks.sparkSession, self.path)


def row_blocks(entries: DataFrame, n: int) -> RowBlocks:
    """Row blocks of an n x n operator from entries (i, j, value), i and j from 1.

    Entries of the same place add up, places without one are 0 and null values count as 0; an empty
    table is the zero operator, and a place outside the operator is an error. The blocks are written
    once; a block has at most BLOCK_ENTRIES numbers or one row, however the entries are spread."""
    if n < 1:
        raise ValueError("an operator has at least one row")
    rows = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // n))
    inside = F.col("i").between(1, n) & F.col("j").between(1, n)
    place = F.when(inside, F.col("i")).otherwise(F.raise_error(F.lit("an entry lies outside the operator"))).cast("int")
    each = entries.select(place.alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("v"))
    each = each.groupBy("i", "j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).select(F.floor((F.col("i") - 1) / rows).cast("int").alias("b"), (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")

    def pack(group: pa.Table) -> pa.Table:
        first = group.column("b")[0].as_py() * rows
        here = min(rows, n - first)
        i, j, v = (group.column(c).to_numpy() for c in "ijv")
        i = i - first
        if 16 * len(v) > 8 * here * n:
            m = np.zeros((here, n))
            m[i, j] = v
            data = [None, None, m.tobytes()]
        else:
            order = np.lexsort((j, i))
            data = [i[order].astype("<i4").tobytes(), j[order].astype("<i4").tobytes(), v[order].astype("<f8").tobytes()]
        return pa.table({"first": pa.array([first], pa.int32()), "rows": pa.array([here], pa.int32()), **{c: pa.array([d], pa.binary()) for c, d in zip("ijv", data, strict=True)}})

    packed = each.groupBy("b").applyInArrow(pack, "first int, rows int, i binary, j binary, v binary")
    blocks, path = write_once(packed, "operator")
    return RowBlocks(blocks, n, path)


def step_operator(steps: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Entries (i, j, value) of the operator of a walk on a ring of ``n`` cells whose steps are drawn from
    the rows of ``steps``: value is the share of rows that lead from cell i to cell j. Steps of any
    size wrap around; null ones are left out."""
    found = steps.where(F.col(step).isNotNull()).groupBy(F.pmod(F.col(step).cast("long"), F.lit(n)).alias("s")).agg(F.count("*").alias("c"))
    # at most n rows, one for each step of the ring
    shares = found.join(F.broadcast(found.agg(F.sum("c").alias("all"))), how="cross").select("s", (F.col("c") / F.col("all")).alias("value"))
    ring = shares.select("s", "value", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"))
    return ring.select((F.col("at") + 1).alias("i"), (F.pmod(F.col("at") + F.col("s"), F.lit(n)) + 1).alias("j"), "value")
