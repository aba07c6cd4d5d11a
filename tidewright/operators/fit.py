"""Estimating the evolution operator: one distributed sum of outer products, a small solve.

K maps features: psi(y) ~ K' psi(x). Ridge fits need the sums G = sum psi_x psi_x',
A = sum psi_x psi_y' and C = sum x psi_x'; least squares without a ridge goes through QR
factors instead, because sums of products square the condition number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.lifts import Dictionary
from tidewright.functions.vectors import EPS, as_lists, rows_of

#: Up to this size the sums are plain aggregates, beyond it blocks from NumPy products.
AGGREGATE_SIZE = 12


def gram(df: DataFrame, by: Sequence[str] = (), left: str = "psi", right: str = "psi", size: tuple[int, int] | None = None) -> DataFrame:
    """(keys, i, j, value): the sum over rows of left[i] * right[j], indices from 1.

    Small products are one aggregate with partial sums; large ones are summed by NumPy in each
    task and then row by row.
    """
    if size is None:
        first = df.select(F.size(left), F.size(right)).first()
        size = tuple(first) if first else (0, 0)
    p, q = size
    if max(size) <= AGGREGATE_SIZE:
        sums = [F.sum(F.get(left, F.lit(i)) * F.get(right, F.lit(j))).alias(f"v{i}_{j}") for i in range(p) for j in range(q)]
        wide = df.groupBy(*by).agg(*sums)
        cells = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"v{i}_{j}").alias("value")) for i in range(p) for j in range(q)])
        return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.i", "c.j", "c.value")
    rows = summed_rows(df, by, left, right, (p, q))
    cells = rows.select(*by, "i", F.posexplode("row").alias("j", "value"))
    return cells.select(*by, "i", (F.col("j") + 1).alias("j"), "value")


#: Numbers that a task holds of grouped sums before it hands them on.
HELD = 1 << 22


def summed_rows(df: DataFrame, by: Sequence[str], left: str, right: str, size: tuple[int, int]) -> DataFrame:
    """(keys, i, row): row i of the sum of left * right' of each key. Each task adds up its own rows
    by NumPy, key by key, and hands on whole rows of the sums, which meet by (key, i)."""
    p, q = size
    types = dict(df.dtypes)
    names = [*by, "i", "row"]

    def pack(totals: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, total in totals.items():
            for a in range(0, p, 256):
                part = total[a : a + 256]
                given = [pa.array([k] * len(part), schemas[c]) for c, k in zip(by, key, strict=True)]
                yield pa.RecordBatch.from_arrays([*given, pa.array(range(a + 1, a + 1 + len(part)), pa.int32()), as_lists(part)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    schemas = {c: to_arrow_type(df.schema[c].dataType) for c in by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x, y = rows_of(b.column(len(by))), rows_of(b.column(len(by) + 1))
                keys = list(zip(*(b.column(c).to_pylist() for c in range(len(by))), strict=True)) if by else [()] * b.num_rows
                number = {k: n for n, k in enumerate(dict.fromkeys(keys))}
                of = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
                for k, n in number.items():
                    mine = slice(None) if len(number) == 1 else of == n
                    add = x[mine].T @ y[mine]
                    totals[k] = totals[k] + add if k in totals else add
                if len(totals) > 1 and len(totals) * p * q > HELD:
                    yield from pack(totals)
                    totals = {}
        yield from pack(totals)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, row in zip(zip(*(b.column(c).to_pylist() for c in range(len(by) + 1)), strict=True), rows_of(b.column(len(by) + 1)), strict=True):
                if key in held:
                    held[key] += row
                else:
                    held[key] = row.copy()
        keys = list(held)
        for a in range(0, len(keys), 256):
            part = keys[a : a + 256]
            given = [pa.array([k[c] for k in part], schemas[x]) for c, x in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*given, pa.array([k[-1] for k in part], pa.int32()), as_lists(np.array([held[k] for k in part]))], names=names)

    ddl = "".join(f"{c} {types[c]}, " for c in by) + "i int, row array<double>"
    parts = df.select(*by, left, F.col(right).alias("_right")).mapInArrow(run, ddl)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, *by, "i").mapInArrow(add_up, ddl)


def dense(table: DataFrame, size: tuple[int, int]) -> np.ndarray:
    """A learned matrix on the driver: its size follows the dictionary, not the data."""
    out = np.zeros(size)
    cells = table.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("value").cast("double")).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in range(3))
    out[i - 1, j - 1] = v
    return out


def product(df: DataFrame, left: str, right: str, size: tuple[int, int]) -> np.ndarray:
    """The sum of left * right' on the driver, size[0] x size[1] doubles that arrive as Arrow rows."""
    if max(size) <= AGGREGATE_SIZE:
        return dense(gram(df, (), left, right, size), size)
    rows = summed_rows(df, (), left, right, size).toArrow()
    out = np.zeros(size)
    if rows.num_rows:
        out[rows.column(0).to_numpy() - 1] = rows_of(rows.column(1))
    return out


def widths(df: DataFrame, *columns: str) -> list[int]:
    row = df.select(*[F.size(c) for c in columns]).first()
    if row is None:
        raise ValueError("no rows to fit")
    return list(row)


def qr_factor(df: DataFrame, columns: Sequence[str], tasks: int = 16, width: int | None = None) -> np.ndarray:
    """R of the QR factorisation of the rows' concatenated columns: each partition reduces its
    rows to one triangle, a few tasks reduce these, and one task the last few."""
    width = width or sum(widths(df, *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held = np.zeros((0, width)), []
        for b in batches:
            if b.num_rows:
                held.append(rows_of(b.column(0)))
            if sum(map(len, held)) >= 8 * width:
                r, held = np.linalg.qr(np.vstack([r, *held]), mode="r"), []
        r = np.linalg.qr(np.vstack([r, *held]), mode="r") if held else r
        if len(r):
            yield pa.RecordBatch.from_arrays([as_lists(r)], names=["row"])

    rows = df.select(F.concat(*columns).alias("row")).mapInArrow(run, "row array<double>")
    # triangles only from here on: a few tasks, then one, whose triangle reaches the driver
    one = rows.repartition(tasks).mapInArrow(run, "row array<double>").repartition(1).mapInArrow(run, "row array<double>")
    return np.linalg.qr(rows_of(one.toArrow().column(0)).reshape(-1, width), mode="r")


def pinv(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m, rcond=EPS * min(m.shape))


def fit_operator(df: DataFrame, method: str = "ridge", alpha: float = 1e-3, x: str = "psi_x", y: str = "psi_y", size: tuple[int, int] | None = None) -> np.ndarray:
    """K of (psi_x, psi_y) rows. ``ridge``: (G + alpha I)^-1 A, both sums in one pass; ``pinv``: least
    squares. ``size``, where it is known, saves a look at a row."""
    p, q = size or widths(df, x, y)
    if method == "ridge":
        both = product(df.select(F.col(x).alias("_x"), F.concat(x, y).alias("_xy")), "_x", "_xy", (p, p + q))
        return np.linalg.solve(both[:, :p] + alpha * np.eye(p), both[:, p:])
    if method == "pinv":
        r = qr_factor(df, [x, y], width=p + q)
        r = np.vstack((r, np.zeros((max(0, p + q - len(r)), p + q))))
        return pinv(r[:, :p]) @ r[:, p:]
    raise ValueError(f"unknown method {method!r}")


def fit_projection(df: DataFrame, x: str = "x", psi: str = "psi_x", alpha: float = 1e-6, size: tuple[int, int] | None = None) -> np.ndarray:
    """B with x ~ B psi: C (G + alpha I)^-1, both sums in one pass."""
    n, p = size or widths(df, x, psi)
    both = product(df.select(F.col(psi).alias("_p"), F.concat(psi, x).alias("_px")), "_p", "_px", (p, p + n))
    return np.linalg.solve(both[:, :p] + alpha * np.eye(p), both[:, p:]).T


def lifted_pairs(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """(.., x, y) with psi_x and psi_y."""
    from tidewright.functions.lifts import lift

    return lift(lift(pairs, d, "x", "psi_x"), d, "y", "psi_y")


def grouped_ridge(df: DataFrame, by: Sequence[str], size: int, alpha: float = 1e-3, x: str = "psi_x", y: str = "psi_y") -> DataFrame:
    """(keys, i, j, value): one ridge operator for each key, solved on the executors; of any size
    that a task can solve. Both sums are one aggregate."""
    both = gram(df.select(*by, F.col(x).alias("_x"), F.concat(x, y).alias("_xy")), by, "_x", "_xy", (size, 2 * size))

    def solve(pdf):
        import pandas as pd

        # 2 size^2 rows a key
        m = pdf.pivot(index="i", columns="j", values="value").to_numpy()
        k = np.linalg.solve(m[:, :size] + alpha * np.eye(size), m[:, size:])
        i, j = np.indices(k.shape)
        out = pd.DataFrame({"i": i.ravel() + 1, "j": j.ravel() + 1, "value": k.ravel()})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    types = dict(df.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in by) + ", i int, j int, value double"
    return both.groupBy(*by).applyInPandas(solve, ddl)


# --- kernels ------------------------------------------------------------------------------

#: Landmarks of a kernel fit, at most; its matrices are square in them.
MAX_LANDMARKS = 5000


def kernel_rows(df: DataFrame, landmarks: np.ndarray, sigma: float, value: str = "x", name: str = "k") -> DataFrame:
    """``df`` with the kernel vector of ``value`` against the landmarks (a bounded matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sq = (landmarks * landmarks).sum(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = rows_of(b.column(b.schema.names.index(value)))
                d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ landmarks.T + sq[None], 0)
                yield pa.RecordBatch.from_arrays([*b.columns, as_lists(np.exp(-d2 / (2 * sigma * sigma)))], names=[*b.schema.names, name])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class KernelFit:
    k: np.ndarray
    b: np.ndarray
    landmarks: np.ndarray
    gram_xx: np.ndarray
    gram_xy: np.ndarray
    sigma: float


def fit_kernel(pairs: DataFrame, sigma: float, alpha: float = 1e-6, n_landmarks: int | None = None, seed: int = 0, keys: Sequence[str] = ("t",)) -> KernelFit:
    """Kernel fit on snapshot pairs, or on ``n_landmarks`` of them by smallest hash.

    The pairs themselves are the basis, so they are bounded by MAX_LANDMARKS; the two Gram
    matrices are filled on the executors.
    """
    bound = n_landmarks or MAX_LANDMARKS
    chosen = pairs.select(*keys, "x", "y").orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(bound + (n_landmarks is None))
    rows = sorted(tuple(r) for r in chosen.collect())
    if len(rows) > bound:
        raise ValueError(f"over {bound} pairs: give n_landmarks, or solve over all pairs by operators.kernel_cg")
    x, y = (np.array([r[len(keys) + c] for r in rows], float) for c in (0, 1))
    spark = pairs.sparkSession
    table = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(len(rows))], "i long, x array<double>, y array<double>")
    table = table.repartition(max(1, min(64, len(rows) // 64)))
    both = kernel_rows(kernel_rows(table, x, sigma, "x", "kx"), x, sigma, "y", "ky").select("i", "kx", "ky").collect()
    both.sort()
    xx, xy = np.array([r.kx for r in both]), np.array([r.ky for r in both]).T
    inv = np.linalg.inv(xx + alpha * np.eye(len(x)))
    return KernelFit(inv @ xy, x.T @ inv, x, xx, xy, sigma)


def kernel_sums(pairs: DataFrame, landmarks: np.ndarray, sigma: float, tasks: int = 16) -> np.ndarray:
    """The sum over all pairs of k(x) [k(x), k(y), x]' for kernel vectors against the landmarks: a
    matrix a partition, a few tasks that add up its rows, the driver."""
    (dim,) = widths(pairs, "x")
    m = len(landmarks)
    sq = (landmarks * landmarks).sum(1)

    def kernel(x: np.ndarray) -> np.ndarray:
        d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ landmarks.T + sq[None], 0)
        return np.exp(-d2 / (2 * sigma * sigma))

    def rows(at: Sequence[int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), as_lists(total)], names=["i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((m, 2 * m + dim)), False
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                x, y = (rows_of(c) for c in whole.slice(at, 512).columns)
                kx, seen = kernel(x), True
                total += kx.T @ np.hstack((kx, kernel(y), x))
        for at in range(0, m if seen else 0, 256):
            yield rows(range(at, min(m, at + 256)), total[at : at + 256])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), rows_of(b.column(1)), strict=True):
                held[i] = held[i] + row if i in held else row.copy()
        if held:
            yield rows(list(held), np.array(list(held.values())))

    # buckets of rows would be few tasks for this much arithmetic
    spread = pairs.select("x", "y").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = spread.mapInArrow(run, "i int, row array<double>").repartition(tasks, "i").mapInArrow(add, "i int, row array<double>")
    return np.array([r.row for r in sorted(sums.collect(), key=lambda r: r.i)])


def fit_landmarks(pairs: DataFrame, sigma: float, n_landmarks: int, alpha: float = 1e-6, seed: int = 0, keys: Sequence[str] = ("t",), landmarks: np.ndarray | None = None) -> KernelFit:
    """Kernel fit on all snapshot pairs; the given landmarks, or ``n_landmarks`` of the pairs' x by
    smallest hash, are only the features: k(y) ~ K' k(x), x ~ B k(x) in least squares with a ridge. Moves states with time."""
    if n_landmarks > MAX_LANDMARKS:
        raise ValueError(f"over {MAX_LANDMARKS} landmarks")
    if landmarks is None:
        chosen = pairs.select(*keys, "x").orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n_landmarks).collect()
        landmarks = np.array([r["x"] for r in sorted(chosen)], float)
    m = len(landmarks)
    sums = kernel_sums(pairs, landmarks, sigma)
    xx, xy, xs = sums[:, :m], sums[:, m : 2 * m], sums[:, 2 * m :]
    solved = np.linalg.solve(xx + alpha * np.eye(m), np.hstack((xy, xs)))
    return KernelFit(solved[:, :m], solved[:, m:].T, landmarks, xx, xy, sigma)


# --- singular vectors ---------------------------------------------------------------------


def signed(u: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude is positive."""
    return u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def principal_axes(df: DataFrame, value: str = "s", width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(U, sigma) of the matrix whose columns are the rows' arrays, by QR factors."""
    r = qr_factor(df, [value], width=width)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return signed(vt.T), s


def principal_axes_by_gram(df: DataFrame, value: str = "s") -> tuple[np.ndarray, np.ndarray]:
    """(U, sigma) from the eigenvectors of the sum of outer products; sigma below about 1e-8 of
    the largest is noise."""
    (n,) = widths(df, value)
    lam, u = np.linalg.eigh(product(df, value, value, (n, n)))
    return signed(u[:, ::-1]), np.sqrt(np.maximum(lam[::-1], 0))


def projected(df: DataFrame, u: np.ndarray, value: str = "s", name: str = "x") -> DataFrame:
    """``df`` with U' value as ``name``, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = as_lists(rows_of(b.column(b.schema.names.index(value))) @ u)
                yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling, a Pade quotient of degree 6, squaring."""
    norm = np.abs(a).sum(1).max() if a.size else 0.0
    k = max(0, int(np.ceil(np.log2(norm))) + 1) if norm > 0 else 0
    a = a / 2.0**k
    c, term, num, den = 1.0, np.eye(len(a)), np.eye(len(a)), np.eye(len(a))
    q = 6
    for j in range(1, q + 1):
        c *= (q - j + 1) / (j * (2 * q - j + 1))
        term = a @ term
        num, den = num + c * term, den + (-1) ** j * c * term
    out = np.linalg.solve(den, num)
    for _ in range(k):
        out = out @ out
    return out
