"""Kernel fits whose basis is every row, by conjugate gradients without a square matrix.

(K + alpha I) W = R is solved for all right sides at once. Rows are dealt into blocks; a pass
evaluates the kernel between two blocks, multiplies and throws it away, so that a pass costs rows^2
kernel values, and memory two blocks. The blocks' vectors stay in tables; the driver sees a few sums of
each right side, and the landmark matrices of the preconditioner, which are as small as the caller says.

Where the points lie in a box of few widths, a bounded number of features makes the kernel to rounding
(``kernel_nodes``). Then one pass sums the features' products, the driver solves a matrix of that many
rows, and a second pass checks the weights: work is rows x features^2, and no pair is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import as_lists, rows_of
from tidewright.operators.kernel_nodes import MAX_DIM, NodeFeatures, node_features
from tidewright.shared import remove, write_once, written

#: Rows of a block: two blocks' kernel values are held in strips.
BLOCK, STRIP = 4096, 512
#: Landmarks of the preconditioner, at most.
MAX_LANDMARKS = 2000


def gaussian(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    d = np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)
    return np.exp(-d / (2 * sigma * sigma))


def packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, "<f8").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, width)


def blocks_of(rows: DataFrame, key: str, parts: dict[str, str], block: int, n: int | None = None) -> tuple[DataFrame, int, str]:
    """(b, keys, one binary for each part): rows dealt into blocks of about ``block`` by their key's hash,
    ordered by key in each; how many there are, and their folder."""
    n = rows.count() if n is None else n
    count = max(1, -(-n // block))
    deal = rows.select(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("b"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("array<double>").alias(name) for name, c in parts.items()])

    def pack(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        data = [packed(rows_of(group.column(p))[order]) for p in parts]
        return pa.table({"b": pa.array([group.column("b")[0].as_py()], pa.int32()), "keys": pa.array([keys[order].astype("<i8").tobytes()], pa.binary()), **{p: pa.array([d], pa.binary()) for p, d in zip(parts, data, strict=True)}})

    ddl = "b int, keys binary, " + ", ".join(f"{p} binary" for p in parts)
    out, path = write_once(deal.groupBy("b").applyInArrow(pack, ddl), "blocks")
    return out, count, path


def kernel_times(points: DataFrame, basis: DataFrame, sigma: float, dim: int, width: int, count: int) -> DataFrame:
    """(b, y) for blocks (b, x) of points: k(points, basis) @ p over all blocks (b, x, p) of the basis.

    Each block of points meets each block of the basis in a row of a join; what they add is summed by
    block."""
    at = points.select("b", F.col("x").alias("x_i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("c"))
    met = at.join(basis.select(F.col("b").alias("c"), F.col("x").alias("x_j"), F.col("p").alias("p_j")), "c").select("b", "x_i", "x_j", "p_j", "c")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x, z, p, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, z, p = unpacked(x, dim), unpacked(z, dim), unpacked(p, width)
                out = np.vstack([gaussian(x[a : a + STRIP], z, sigma) @ p for a in range(0, len(x), STRIP)])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed(out)], pa.binary())], names=["b", "y"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, "<f8") for v in group.column("y").to_pylist())
        return pa.table({"b": group.column("b")[:1], "y": pa.array([total.tobytes()], pa.binary())})

    return met.repartition(max(1, min(2000, count * count)), "b", "c").mapInArrow(multiply, "b int, y binary").groupBy("b").applyInArrow(add, "b int, y binary")


def mapped(df: DataFrame, f, ddl: str) -> DataFrame:
    """A row of binaries at a time through ``f``, which gets and gives the columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([f(row)], schema=schema)

    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    return df.mapInArrow(run, ddl)


#: Tasks that the tasks' sums meet in.
MEET = 8


def total(df: DataFrame, column: str, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of a small packed matrix over blocks: in each task, in MEET tasks, on the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(int(np.prod(shape)))
        for batch in batches:
            for v in batch.column(0):
                whole += np.frombuffer(v.as_buffer(), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([packed(whole)], pa.binary())], names=[column])

    ddl = f"{column} binary"
    some = df.select(column).mapInArrow(added, ddl).repartition(MEET).mapInArrow(added, ddl)
    return sum((np.frombuffer(r[0], "<f8") for r in some.collect()), np.zeros(int(np.prod(shape)))).reshape(shape)


def limits_of(rows: DataFrame, value: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, and each coordinate's least and greatest value."""
    at = [F.get(value, F.lit(c)) for c in range(dim)]
    found = rows.agg(F.count("*"), *[f(c) for c in at for f in (F.min, F.max)]).first()
    ends = np.array([np.nan if v is None else v for v in found[1:]], float)
    return found[0], ends[::2], ends[1::2]


@dataclass
class KernelSolution:
    """``blocks`` (b, keys, x, p): the basis and its weights p. ``residual``: of each right side, the
    norm of what is left over its own norm; ``passes``: products with the kernel. ``features`` make the
    kernel where they are given, and ``moments`` are their products with the weights."""

    blocks: DataFrame
    sigma: float
    dim: int
    width: int
    count: int
    residual: np.ndarray
    passes: int
    features: NodeFeatures | None = None
    moments: np.ndarray | None = None

    def evaluate(self, points: DataFrame, key: str = "t", value: str = "x") -> DataFrame:
        """(key, y): k(point, basis) @ weights for each row of ``points``."""
        if self.features is not None:
            n, low, high = limits_of(points, value, self.dim)
            if n and (low >= self.features.low).all() and (high <= self.features.high).all():
                return self._evaluate_features(points, key, value)
        at, _, _ = blocks_of(points, key, {"x": value}, BLOCK)
        out = at.join(kernel_times(at, self.blocks, self.sigma, self.dim, self.width, self.count), "b").select("keys", "y")
        width = self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, "<i8")), as_lists(unpacked(y, width))], names=["key", "y"])

        return out.mapInArrow(rows, "key long, y array<double>").withColumnRenamed("key", key)

    def _evaluate_features(self, points: DataFrame, key: str, value: str) -> DataFrame:
        features, moments = self.features, self.moments

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, STRIP):
                    b = batch.slice(a, STRIP)
                    yield pa.RecordBatch.from_arrays([b.column(0), as_lists(features(rows_of(b.column(1))) @ moments)], names=["key", "y"])

        slim = points.select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("x"))
        return slim.mapInArrow(rows, "key long, y array<double>").withColumnRenamed("key", key)


def solve_by_features(rows: DataFrame, features: NodeFeatures, n: int, sigma: float, alpha: float, key: str, value: str, right: str, tol: float, passes: int, block: int, dim: int, width: int) -> KernelSolution:
    """``solve_kernel`` where the kernel is C C' for features C: the weights are (R - C c) / alpha with
    (C'C + alpha I) c = C'R, and what is left of R is C (c - C'W)."""
    rank = features.rank
    base, count, path = blocks_of(rows, key, {"x": value, "r": right}, block, n)

    def begun(row: dict) -> dict:
        x, r = unpacked(row["x"], dim), unpacked(row["r"], width)
        out = np.zeros((rank + 1, rank + width))
        out[rank, rank:] = (r * r).sum(0)
        for a in range(0, len(x), STRIP):
            c = features(x[a : a + STRIP])
            out[:rank, :rank] += c.T @ c
            out[:rank, rank:] += c.T @ r[a : a + STRIP]
        return {"m": packed(out)}

    def weights(row: dict, coefs: np.ndarray) -> np.ndarray:
        x, r = unpacked(row["x"], dim), unpacked(row["r"], width)
        return np.vstack([(r[a : a + STRIP] - features(x[a : a + STRIP]) @ coefs) / alpha for a in range(0, len(x), STRIP)])

    def checked(row: dict, coefs: np.ndarray) -> dict:
        x, w = unpacked(row["x"], dim), weights(row, coefs)
        return {"m": packed(sum(features(x[a : a + STRIP]).T @ w[a : a + STRIP] for a in range(0, len(x), STRIP)))}

    whole = total(mapped(base.select("x", "r"), begun, "m binary"), "m", (rank + 1, rank + width))
    gram, cr, norm = whole[:rank, :rank], whole[:rank, rank:], np.sqrt(np.maximum(whole[rank, rank:], 1e-300))
    value_, vector = np.linalg.eigh(gram)
    answer = lambda m: vector @ ((vector.T @ m) / (np.maximum(value_, 0) + alpha)[:, None])
    coefs, done = answer(cr), 0
    while True:
        moments = total(mapped(base.select("x", "r"), lambda row, coefs=coefs: checked(row, coefs), "m binary"), "m", (rank, width))
        off, done = coefs - moments, done + 1
        left = np.sqrt(np.maximum((off * (gram @ off)).sum(0), 0)) / norm
        if (left <= tol).all() or done >= passes:
            break
        coefs = coefs - alpha * answer(off)
    blocks = written(mapped(base, lambda row: {k: row[k] for k in ("b", "keys", "x")} | {"p": packed(weights(row, coefs))}, "b int, keys binary, x binary, p binary"), "weights")
    remove(rows.sparkSession, path)
    return KernelSolution(blocks, sigma, dim, width, count, left, done, features, moments)


def solve_kernel(rows: DataFrame, sigma: float, alpha: float, key: str = "t", value: str = "x", right: str = "y", landmarks: int = 200, tol: float = 1e-8, passes: int = 200, block: int = BLOCK) -> KernelSolution:
    """Weights W of (K + alpha I) W = R over all rows (key, value, right), K the Gaussian kernel of the
    values, R the right sides row by row.

    The preconditioner is the same matrix with K replaced by its projection on ``landmarks`` rows of
    smallest hash, inverted by Woodbury's identity. Each iteration makes the kernel once and writes the
    blocks' vectors; it ends when every right side's residual is below ``tol`` of its norm, or after
    ``passes``, and the residuals are reported either way. Where a quarter as many features as rows, or
    fewer, make the kernel, they solve it instead."""
    if alpha <= 0 or not 0 < landmarks <= MAX_LANDMARKS:
        raise ValueError("alpha has to be positive, and landmarks from 1 to MAX_LANDMARKS")
    first = rows.select(F.size(value), F.size(right)).first()
    if first is None:
        raise ValueError("no rows to fit")
    dim, width = first
    n = None
    if dim <= MAX_DIM:
        n, low, high = limits_of(rows, value, dim)
        features = node_features(low, high, sigma)
        if features is not None and 4 * features.rank <= n:
            return solve_by_features(rows, features, n, sigma, alpha, key, value, right, tol, passes, block, dim, width)
    base, count, path = blocks_of(rows, key, {"x": value, "r": right}, block, n)
    some = rows.select(F.col(value).cast("array<double>").alias("x")).orderBy(F.xxhash64(key, F.lit(3)), key).limit(landmarks).collect()
    z = np.unique(np.array([s["x"] for s in some], float), axis=0)
    kzz = gaussian(z, z, sigma)

    # K ~ C C' with C = k(X, Z) kzz^(-1/2): Woodbury needs C'C only
    lam, u = np.linalg.eigh(kzz)
    keep = lam > 1e-10 * lam[-1]
    half = u[:, keep] / np.sqrt(lam[keep])
    rank = half.shape[1]

    def features(x: np.ndarray) -> np.ndarray:
        return gaussian(x, z, sigma) @ half

    def gram_of(row: dict) -> dict:
        x, out = unpacked(row["x"], dim), np.zeros((rank, rank))
        for a in range(0, len(x), STRIP):
            c = features(x[a : a + STRIP])
            out += c.T @ c
        return {"m": packed(out)}

    small = np.linalg.inv(total(mapped(base.select("x"), gram_of, "m binary"), "m", (rank, rank)) + alpha * np.eye(rank))

    kept = "b int, keys binary, x binary, w binary, r binary, p binary"

    def begun(row: dict) -> dict:
        r = unpacked(row["r"], width)
        return {"m": packed(np.vstack(((r * r).sum(0)[None], features(unpacked(row["x"], dim)).T @ r)))}

    def sums(row: dict) -> dict:
        """Of each right side p.q, r.r, r.q, q.q and C'q."""
        p, q, r = (unpacked(row[c], width) for c in "pqr")
        return {"m": packed(np.vstack(((p * q).sum(0)[None], (r * r).sum(0)[None], (r * q).sum(0)[None], (q * q).sum(0)[None], features(unpacked(row["x"], dim)).T @ q)))}

    def left_over(frame: DataFrame) -> np.ndarray:
        return total(mapped(frame.select("r"), lambda row: {"m": packed((unpacked(row["r"], width) ** 2).sum(0))}, "m binary"), "m", (width,))

    def moved(row: dict, step: np.ndarray, inner: np.ndarray, beta: np.ndarray) -> dict:
        """One step along p; the next p is the preconditioner's answer to what is left."""
        p = unpacked(row["p"], width)
        r = unpacked(row["r"], width) - unpacked(row["q"], width) * step
        z = (r - features(unpacked(row["x"], dim)) @ inner) / alpha
        return {k: row[k] for k in ("b", "keys", "x")} | {"w": packed(unpacked(row["w"], width) + p * step), "r": packed(r), "p": packed(z + p * beta)}

    whole = total(mapped(base.select("x", "r"), begun, "m binary"), "m", (rank + 1, width))
    rr, cr = whole[0], whole[1:]
    norm = np.sqrt(np.maximum(rr, 1e-300))
    # r.z is known from r.r and C'r
    answer = lambda rr, cr: np.maximum((rr - (cr * (small @ cr)).sum(0)) / alpha, 0)
    rz, still = answer(rr, cr), np.zeros(width)
    start = mapped(base, lambda row: row | {"w": packed(np.zeros(len(row["r"]) // 8)), "p": row["r"], "q": row["r"]}, kept + ", q binary")
    state, at = write_once(mapped(start, lambda row, inner=small @ cr: moved(row, still, inner, still), kept), "cg")
    remove(rows.sparkSession, path)
    left, done = np.where(rr > 0, 1.0, 0.0), 0
    while (left > tol).any() and done < passes:
        product = kernel_times(state, state, sigma, dim, width, count)
        met = mapped(state.join(product, "b"), lambda row: {k: row[k] for k in ("b", "keys", "x", "w", "r", "p")} | {"q": packed(unpacked(row["y"], width) + alpha * unpacked(row["p"], width))}, kept + ", q binary")
        met, between = write_once(met, "cg")
        remove(rows.sparkSession, at)
        whole = total(mapped(met.select("x", "r", "p", "q"), sums, "m binary"), "m", (rank + 4, width))
        pq, rr, rq, qq = whole[:4]
        step = np.where((pq > 0) & (left > tol), rz / np.where(pq > 0, pq, 1), 0.0)  # a right side that is solved stays
        cr = cr - whole[4:] * step
        rr = np.maximum(rr - 2 * step * rq + step * step * qq, 0)
        new = answer(rr, cr)
        beta, rz = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0), new
        state, at = write_once(mapped(met, lambda row, step=step, inner=small @ cr, beta=beta: moved(row, step, inner, beta), kept), "cg")
        remove(rows.sparkSession, between)
        left, done = np.sqrt(rr) / norm, done + 1
    blocks = state.select("b", "keys", "x", F.col("w").alias("p"))
    return KernelSolution(blocks, sigma, dim, width, count, np.sqrt(left_over(state)) / norm, done)
