"""Feature dictionaries: polynomial, radial and random Fourier.

A dictionary lifts a state both as a column expression (inside generated code, for small
sizes and literal centres) and as a NumPy batch (for large ones).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import as_lists, rows_of, squared_distance

#: Added to a distance before its logarithm.
TINY = 1e-12


def exponents(n: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of total degree up to ``degree``, by degree; in each, later variables first."""
    if n < 1 or degree < 0:
        raise ValueError("a dictionary needs a variable and a degree of 0 or more")
    out = []
    for d in range(degree + 1):
        out += sorted(e for e in itertools.product(range(d + 1), repeat=n) if sum(e) == d)
    return out


def hermite_values(x, degree: int, kind: str, one):
    """H_0 .. H_degree at x by the recurrence, for columns or arrays."""
    if kind not in ("probabilist", "physicist"):
        raise ValueError(f"unknown basis {kind!r}")
    a = 1.0 if kind == "probabilist" else 2.0
    h = [one, a * x]
    for k in range(1, degree):
        h.append(a * x * h[k] - (a * k) * h[k - 1])
    return h[: degree + 1]


@dataclass(frozen=True)
class Hermite:
    dim: int
    degree: int = 2
    kind: str = "probabilist"

    @property
    def size(self) -> int:
        return len(exponents(self.dim, self.degree))

    def column(self, x: Column) -> Column:
        h = [hermite_values(F.get(x, F.lit(i)), self.degree, self.kind, F.lit(1.0)) for i in range(self.dim)]
        out = []
        for e in exponents(self.dim, self.degree):
            term = F.lit(1.0)
            for i, k in enumerate(e):
                term = term * h[i][k] if k else term
            out.append(term)
        return F.array(*out)

    def batch(self, x: np.ndarray) -> np.ndarray:
        h = [hermite_values(x[:, i], self.degree, self.kind, np.ones(len(x))) for i in range(self.dim)]
        return np.column_stack([np.prod([h[i][k] for i, k in enumerate(e)], axis=0) for e in exponents(self.dim, self.degree)])

    def projection(self) -> np.ndarray:
        """(dim, size): the selector of the linear features, which for the physicist kind are 2x."""
        if self.degree < 1:
            raise ValueError("a projection needs degree 1 or more")
        b = np.zeros((self.dim, self.size))
        for j, e in enumerate(exponents(self.dim, self.degree)):
            if sum(e) == 1:
                b[e.index(1), j] = 1.0 if self.kind == "probabilist" else 0.5
        return b

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return numeric_gradient(self.batch, x)


@dataclass(frozen=True)
class Radial:
    """[1, x, phi_1, ...] with states, else the radial features only."""

    centers: tuple[tuple[float, ...], ...]
    kernel: str = "thinplate"
    sigma: float | None = None
    include_states: bool = True
    state_indices: tuple[int, ...] | None = None
    stats: tuple[tuple[float, float], ...] | None = None

    def __post_init__(self):
        if self.kernel not in ("thinplate", "gaussian"):
            raise ValueError(f"unknown kernel {self.kernel!r}")
        if self.kernel == "gaussian" and (self.sigma is None or self.sigma <= 0):
            raise ValueError("a gaussian dictionary needs a positive sigma")
        if self.stats and not self.include_states:
            raise ValueError("normalised states have to be included")

    @property
    def dim(self) -> int:
        return len(self.centers[0])

    @property
    def states(self) -> tuple[int, ...]:
        return tuple(range(self.dim)) if self.state_indices is None else self.state_indices

    @property
    def size(self) -> int:
        return len(self.centers) + (1 + len(self.states)) * self.include_states

    def column(self, x: Column) -> Column:
        if self.stats:
            x = F.array(*[(F.get(x, F.lit(i)) - m) / s for i, (m, s) in enumerate(self.stats)])
        d2 = lambda c: squared_distance(x, F.array(*[F.lit(v) for v in c]))
        if self.kernel == "gaussian":
            phi = [F.exp(-d2(c) / F.lit(2.0 * self.sigma * self.sigma)) for c in self.centers]
        else:
            r = F.transform(F.array(*[d2(c) for c in self.centers]), lambda v: F.sqrt(v) + TINY)
            phi = F.transform(r, lambda v: v * v * F.log(v))
            return F.concat(self._states(x), phi) if self.include_states else phi
        return F.concat(self._states(x), F.array(*phi)) if self.include_states else F.array(*phi)

    def _states(self, x: Column) -> Column:
        return F.array(F.lit(1.0), *[F.get(x, F.lit(i)) for i in self.states])

    def batch(self, x: np.ndarray) -> np.ndarray:
        if self.stats:
            m, s = np.array(self.stats).T
            x = (x - m) / s
        c = np.array(self.centers)
        d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
        if self.kernel == "gaussian":
            phi = np.exp(-d2 / (2 * self.sigma**2))
        else:
            r = np.sqrt(d2) + TINY
            phi = r * r * np.log(r)
        return np.hstack((np.ones((len(x), 1)), x[:, self.states], phi)) if self.include_states else phi

    def gradient(self, s: np.ndarray) -> np.ndarray:
        """(dim, size) Jacobian at one state, with the kernel's own rule and the scaling's."""
        scale = np.ones(self.dim)
        if self.stats:
            m, scale = np.array(self.stats).T
            s = (s - m) / scale
        diff = s[None] - np.array(self.centers)
        r = np.sqrt((diff * diff).sum(1))
        if self.kernel == "gaussian":
            factor = -np.exp(-r * r / (2 * self.sigma**2)) / self.sigma**2
        else:
            near = r + TINY
            factor = np.where(r < 1e-10, 0.0, (2 * np.log(near) + 1) * near / np.where(r > 0, r, 1.0))
        g = diff.T * factor
        if self.include_states:
            unit = np.zeros((self.dim, len(self.states)))
            unit[list(self.states), np.arange(len(self.states))] = 1
            g = np.hstack((np.zeros((self.dim, 1)), unit, g))
        return g / scale[:, None]


@dataclass(frozen=True)
class Fourier:
    """sqrt(2 / D) cos(Wx + b); with states, these come first and there is no constant."""

    w: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    include_states: bool = False

    @classmethod
    def random(cls, dim: int, count: int = 500, sigma: float = 1.0, include_states: bool = False, seed: int = 0) -> Fourier:
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((count, dim)) / sigma
        return cls(tuple(map(tuple, w.tolist())), tuple(rng.uniform(0, 2 * np.pi, count).tolist()), include_states)

    @property
    def dim(self) -> int:
        return len(self.w[0])

    @property
    def size(self) -> int:
        return len(self.b) + self.dim * self.include_states

    def column(self, x: Column) -> Column:
        scale = float(np.sqrt(2.0 / len(self.b)))
        out = []
        for row, b in zip(self.w, self.b, strict=True):
            angle = F.lit(b)
            for i, v in enumerate(row):
                angle = angle + F.lit(v) * F.get(x, F.lit(i))
            out.append(F.lit(scale) * F.cos(angle))
        return F.concat(x, F.array(*out)) if self.include_states else F.array(*out)

    def batch(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.b)) * np.cos(x @ np.array(self.w).T + np.array(self.b))
        return np.hstack((x, z)) if self.include_states else z

    def gradient(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.w)
        g = -np.sqrt(2.0 / len(self.b)) * np.sin(w @ x + np.array(self.b)) * w.T
        return np.hstack((np.eye(self.dim), g)) if self.include_states else g


Dictionary = Hermite | Radial | Fourier

#: Up to this size a lift is a column expression, beyond it an Arrow batch.
EXPRESSION_SIZE = 40


def numeric_gradient(f, x: np.ndarray, h: float = 1e-6) -> np.ndarray:
    out = []
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = h
        out.append((f((x + e)[None])[0] - f((x - e)[None])[0]) / (2 * h))
    return np.array(out)


def lift(df: DataFrame, d: Dictionary, value: str = "x", name: str = "psi") -> DataFrame:
    """``df`` with the lifted ``value`` as ``name``."""
    if d.size <= EXPRESSION_SIZE:
        return df.withColumn(name, d.column(F.col(value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                psi = as_lists(d.batch(rows_of(batch.column(batch.schema.names.index(value)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, psi], names=[*batch.schema.names, name])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def gradients(df: DataFrame, d: Dictionary, keys: Sequence[str], value: str = "x", xi: np.ndarray | None = None) -> DataFrame:
    """(keys, i, j, value) of every row's Jacobian of the features (coordinate i, feature j, from 1),
    or, with coefficients ``xi``, (keys, i, value) of the gradient of Re(psi' xi)."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = np.array([d.gradient(x) for x in rows_of(b.column(len(keys)))])
            g = np.real(g @ xi)[:, :, None] if xi is not None else g
            n, p, q = g.shape
            given = [c.take(pa.array(np.repeat(np.arange(n), p * q))) for c in b.columns[: len(keys)]]
            i, j = (np.tile(v.ravel() + 1, n).astype(np.int32) for v in np.indices((p, q)))
            yield pa.RecordBatch.from_arrays([*given, pa.array(i), pa.array(j), pa.array(g.ravel())], names=[*keys, "i", "j", "value"])

    out = df.select(*keys, value).mapInArrow(run, "".join(f"{k} {types[k]}, " for k in keys) + "i int, j int, value double")
    return out.drop("j") if xi is not None else out


def lift_state(d: Dictionary, x: Sequence[float]) -> np.ndarray:
    return d.batch(np.asarray(x, float)[None])[0]


def padded(value: Column, full_dim: int, active: Sequence[int], fixed: dict[int, float] | None = None) -> Column:
    """A slice's coordinates put back among fixed ones (0 unless given); indices from 0."""
    place = {d: i for i, d in enumerate(active)}
    return F.array(*[F.get(value, F.lit(place[d])) if d in place else F.lit(float((fixed or {}).get(d, 0.0))) for d in range(full_dim)])


def cluster_centers(df: DataFrame, k: int, value: str = "x", max_points: int | None = None, seed: int = 0, key: str | None = None) -> list[tuple[float, ...]]:
    """k-means centres of a column of arrays, from at most ``max_points`` rows if given: those of
    smallest hash, so that the seed decides."""
    points = df.select(F.col(value).cast("array<double>").alias("x"), *([key] if key else []))
    if max_points:
        points = points.orderBy(F.xxhash64(key or "x", F.lit(seed))).limit(max_points)
    model = KMeans(k=k, maxIter=2000, seed=seed, featuresCol="f").fit(points.select(array_to_vector("x").alias("f")))
    return [tuple(map(float, c)) for c in model.clusterCenters()]
