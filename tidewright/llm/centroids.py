"""Centroid clustering of integer vectors, exact in every sum.

Squared distances come as |x|^2 - 2 x.c + |c|^2 from one float64 matrix product a block. Integers
in doubles are exact below 2^53, so a row takes that way only while dim * (|x| + |c|)^2, with the
largest magnitudes of the row and of all centroids, stays below; other rows take 64-bit integers
while those hold every sum, and Python's integers beyond. Sums of clusters leave each task as one
row and meet in RDD.treeAggregate as Python's integers, so that they never round or overflow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import written

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Rows of one matrix product.
BLOCK = 4096
#: Integers up to here are exact in doubles.
EXACT = 1 << 53
MOST = (1 << 63) - 1
#: Centroids travel with each task: at most so many numbers.
MAX_CENTROID_CELLS = 1 << 20


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors with ``dim`` finite components, each floor(scale * component) as
    ``dim`` little-endian doubles in one binary. A component whose product passes the doubles' range
    counts as non-finite; null vectors and vectors of another length go; a null id stays."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(value).cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & (F.abs(c * scale) < F.lit(float("inf")))
    rows = rows.where((F.size("x") == dim) & F.forall("x", lambda c: F.coalesce(finite(c), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.floor(b.column(1).flatten().to_numpy() * scale).astype("<f8").reshape(-1, dim) + 0.0
                data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 8 * x.size + 1, 8 * dim, dtype=np.int32)), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0), data], names=["vec_id", "x"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, x binary")


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of packed doubles as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], "<f8", (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, dim)


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of whole doubles, the smaller number of equals;
    distances are 64-bit integers, or Python's where a row needs them."""
    top = max((abs(v) for c in centroids for v in c), default=0)
    size = np.abs(x).max(1, initial=0.0)
    dim = x.shape[1]
    # the bounds hold for every partial sum of the expansion and of the differences
    by_product = np.zeros(len(x), bool) if dim * top * top >= EXACT else dim * (size + float(top)) ** 2 < EXACT / 2
    by_long = ~by_product & ((size + float(top)) ** 2 * dim < 2.0**62) if top < 1 << 31 else np.zeros(len(x), bool)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if by_product.any():
        c = np.array(centroids, np.float64)
        rows = x if by_product.all() else x[by_product]
        d = rows @ (-2.0 * c.T)
        d += np.einsum("ij,ij->i", rows, rows)[:, None]
        d += np.einsum("ij,ij->i", c, c)
        best = d.argmin(1)
        cluster[by_product], distance[by_product] = best, d[np.arange(len(d)), best].astype(np.int64)
    if by_long.any():
        rows, c = x[by_long].astype(np.int64), np.array(centroids, np.int64)
        d = np.stack([((rows - v) ** 2).sum(1) for v in c], 1)
        best = d.argmin(1)
        cluster[by_long], distance[by_long] = best, d[np.arange(len(d)), best]
    rest = np.flatnonzero(~(by_product | by_long))
    if len(rest):
        distance = distance.astype(object)
        for i, row in zip(rest, integers(x[rest]), strict=True):
            each = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
            cluster[i] = min(range(len(each)), key=each.__getitem__)
            distance[i] = each[cluster[i]]
    return cluster, distance


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of whole doubles, column by column."""
    if len(x) * float(np.abs(x).max(initial=0.0)) < EXACT:
        return [int(v) for v in x.sum(0)]
    return [int(v) for v in integers(x).sum(0)]


def cluster_sums(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """For each centroid: the number of its vectors, their distances' sum, their components' sums.
    A task hands on one row; rows meet in a tree."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = [[0] * (dim + 2) for _ in range(k)], False
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                x, seen = matrix_of(whole.column(0).slice(at, BLOCK), dim), True
                cluster, distance = nearest(x, centroids)
                for c in np.unique(cluster):
                    mine = cluster == c
                    add = [int(mine.sum()), sum(map(int, distance[mine])), *column_sums(x[mine])]
                    total[c] = [a + b for a, b in zip(total[c], add, strict=True)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, (v for row in total for v in row)))])], names=["sums"])

    def add(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    parts = vectors.select("x").mapInArrow(run, "sums string").rdd
    flat = parts.treeAggregate([0] * (k * (dim + 2)), lambda total, row: add(total, [int(v) for v in row[0].split()]), add, depth=2)
    return [flat[i * (dim + 2) : (i + 1) * (dim + 2)] for i in range(k)]


@dataclass(frozen=True)
class Clusters:
    """``centroids`` in order of their numbers; ``vectors`` as ``integer_vectors`` gives them."""

    vectors: DataFrame
    centroids: list[list[int]]
    dim: int

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[c])).encode()).hexdigest()


def start_centroids(vectors: DataFrame, k: int, seed: int, dim: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of "seed:vec_id", all where there are fewer; a null
    id is empty text, and rows that repeat an id go by their components' bytes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()  # k rows
    return [[int(v) for v in np.frombuffer(r["x"], "<f8", dim)] for r in rows]


def fit_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> Clusters:
    """``rounds`` rounds of assigning every vector to the nearest centroid and moving each non-empty
    centroid to floor(sum / count); rounds that would change nothing any more are left out.

    Vectors are converted and written once; each round reads them and moves k sums a task."""
    if k * dim > MAX_CENTROID_CELLS:
        raise ValueError(f"over {MAX_CENTROID_CELLS} numbers of centroids")
    vectors = written(integer_vectors(vectors, dim), "vectors")
    centroids = start_centroids(vectors, k, seed, dim)
    for _ in range(rounds if centroids else 0):
        sums = cluster_sums(vectors, centroids, dim)
        moved = [[s // n for s in parts] if n else old for old, (n, _, *parts) in zip(centroids, sums, strict=True)]
        if moved == centroids:
            break
        centroids = moved
    return Clusters(vectors, centroids, dim)


def assign(model: Clusters) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a distance past 64 bits is their largest number."""
    centroids, dim = model.centroids, model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                cluster, distance = nearest(matrix_of(b.column(1), dim), centroids)
                if distance.dtype == object:
                    distance = np.array([min(MOST, int(d)) for d in distance], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return model.vectors.mapInArrow(run, f"vec_id {dict(model.vectors.dtypes)['vec_id']}, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row of
    ``vectors`` (vec_id, embedding) with ``dim`` finite components.

    Null vectors, null or non-finite components and other lengths: no row. Rows that repeat an id
    are vectors each. Ties go to the smaller cluster number. Fewer vectors than k: as many
    centroids; none: an empty table. Inertias past 64 bits are their largest number. Other columns
    aren't read, whatever their names.
    """
    model = fit_clusters(vectors, k, rounds, seed, dim)
    spark = vectors.sparkSession
    inertia = [s[1] for s in cluster_sums(model.vectors, model.centroids, dim)] if model.centroids else []
    rows = [(c, min(MOST, d), min(MOST, sum(inertia)), model.digest(c)) for c, d in enumerate(inertia)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(model).join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """The same by SQL, round by round, in 128-bit integers."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::HUGEINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c::DOUBLE))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, vec_id, c, "
            f"list_sum(list_transform(list_zip(v.x, c{n}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, c{n}) GROUP BY r)"
        )
        if n < rounds:
            whole = "(s - ((s % n + n) % n)) // n"
            steps.append(
                f"m{n} AS MATERIALIZED (SELECT c, list({whole} ORDER BY i) AS x FROM (SELECT a{n}.c, i, sum(v.x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{n} ON v.r = a{n}.r, range(1, {dim + 1}) t(i) GROUP BY ALL) GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c)"
            )
    z = rounds
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, "
        f"(sum(a.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(list_transform(f.x, lambda e: e::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM a{z} a JOIN c{z} f ON a.c = f.c"
    )


ORACLE = oracle()
