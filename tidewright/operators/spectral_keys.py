"""Spectra of many operators at once: a table of modes (keys, k, re, im), k from 1 in each key.

One operator for each key is solved in a group of its own; what follows, the choice of modes and their
powers, are joins and aggregates over all keys together. All families of a key are a walk over its modes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.spectral import eigendecomposition
from tidewright.shared import written


def spectra(operators: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, k, re, im, xi_re, xi_im) of (keys, i, j, value): each key's eigenpairs, largest first. A
    key's operator is as large as its features are many, and is solved by one task."""
    by = list(by)

    def solve(pdf):
        import pandas as pd

        n = int(pdf["i"].max())
        m = np.zeros((n, n))
        m[pdf["i"].to_numpy() - 1, pdf["j"].to_numpy() - 1] = pdf["value"]
        values, vectors = eigendecomposition(m)
        out = pd.DataFrame({"k": np.arange(1, n + 1, dtype=np.int32), "re": values.real, "im": values.imag})
        out["xi_re"], out["xi_im"] = list(vectors.real.T.copy()), list(vectors.imag.T.copy())
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "k", "re", "im", "xi_re", "xi_im"]]

    types = dict(operators.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in by) + ", k int, re double, im double, xi_re array<double>, xi_im array<double>"
    return operators.groupBy(*by).applyInPandas(solve, ddl)


def magnitude(re: Column | str = "re", im: Column | str = "im") -> Column:
    re, im = (F.col(c) if isinstance(c, str) else c for c in (re, im))
    return F.sqrt(re * re + im * im)


def leading(modes: DataFrame, by: Sequence[str], howmany: int) -> DataFrame:
    """The ``howmany`` modes of largest magnitude of each key with their ``place``; those that are
    equal to nine digits, as the two of a pair are, by k."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round(magnitude(), 9).desc(), "k"))
    return modes.withColumn("place", place).where(F.col("place") <= howmany)


def on_the_circle(mag_tol: float = 0.05) -> Column:
    """Modes of the upper half near the unit circle, without 1 itself."""
    return (F.abs(magnitude() - 1) <= mag_tol) & (F.col("im") > 1e-6) & (magnitude(F.col("re") - 1, "im") > 1e-8)


def families_of(modes: DataFrame, bases: DataFrame, by: Sequence[str], max_harmonic: int = 5, growth: float = 1.5) -> DataFrame:
    """(keys, base, k), each once: of bases (keys, base, tol), the mode itself, the first mode within
    tol of its conjugate, and for each power from 2 the modes nearest to the power and to its
    conjugate, if nearer than tol * growth^(power - 1)."""
    by = list(by)
    modes = modes.select(*by, "k", "re", "im")
    b = bases.join(modes.withColumnRenamed("k", "base"), [*by, "base"])
    b = b.select(*by, "base", "tol", magnitude().alias("_r"), F.atan2("im", "re").alias("_a"))
    b = b.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(max_harmonic)))).withColumn("_s", F.explode(F.array(F.lit(1), F.lit(-1))))
    size, turn = F.pow("_r", F.col("_h")), F.col("_h") * F.col("_a")
    b = b.where("NOT (_h = 1 AND _s = 1)").withColumn("_x", size * F.cos(turn)).withColumn("_y", F.col("_s") * size * F.sin(turn))
    near = b.join(modes, by).withColumn("_d", magnitude(F.col("re") - F.col("_x"), F.col("im") - F.col("_y")))  # 2 max_harmonic - 1 targets a base
    target = [*by, "base", "tol", "_h", "_s"]
    found = near.groupBy(*target).agg(F.min(F.struct("_d", "k")).alias("n"), F.min(F.when(F.col("_d") < F.col("tol"), F.col("k"))).alias("first"))
    reach = F.col("tol") * F.pow(F.lit(float(growth)), F.col("_h") - 1)
    k = F.when(F.col("_h") == 1, F.col("first")).when(F.col("n._d") < reach, F.col("n.k"))
    out = found.select(*by, "base", k.alias("k")).where("k IS NOT NULL")
    return out.unionByName(bases.select(*by, "base", F.col("base").alias("k"))).distinct()


def phase_and_amplitude(modes: DataFrame, by: Sequence[str], dt: float, tol_unity: float = 1e-3, tol_imag: float = 1e-4, tol_harmonic: float = 0.05, growth: float = 1.0, max_harmonic: int = 5) -> tuple[DataFrame, DataFrame]:
    """((keys, phase_k, phase_re, phase_im, amplitude_k, amplitude_re, amplitude_im), (keys, base, k)):
    the slowest turning mode on the unit circle and, outside of its family, the largest real mode
    (the largest real part where none is real), as log(value) / dt; and the families. Keys without
    both, or whose amplitude is 0, have no row."""
    by = list(by)
    moving = modes.where(magnitude(F.col("re") - 1, "im") > tol_unity)
    turning = moving.where((F.abs(magnitude() - 1) < tol_unity) & (F.col("im") > tol_imag))
    phase = turning.groupBy(*by).agg(F.min(F.struct("im", "k", "re")).alias("p")).select(*by, F.col("p.k").alias("base"), F.col("p.re").alias("p_re"), F.col("p.im").alias("p_im"))
    family = written(families_of(modes, phase.select(*by, "base", F.lit(float(tol_harmonic)).alias("tol")), by, max_harmonic, growth), "families")
    rest = moving.join(phase.select(*by), by, "left_semi").join(family.select(*by, "k"), [*by, "k"], "left_anti")
    real = F.abs(F.col("im")) < tol_imag
    best = rest.groupBy(*by).agg(F.max(F.struct(real.alias("real"), F.col("re"), (-F.col("k")).alias("_k"), F.col("im"))).alias("a"))
    both = phase.join(best, by).where((F.col("a.re") != 0) | (F.col("a.im") != 0))
    log = lambda re, im: (F.log(magnitude(re, im)) / dt, F.atan2(im, re) / dt)
    p, a = log(F.col("p_re"), F.col("p_im")), log(F.col("a.re"), F.col("a.im"))
    out = both.select(
        *by, F.col("base").alias("phase_k"), p[0].alias("phase_re"), p[1].alias("phase_im"), (-F.col("a._k")).cast("int").alias("amplitude_k"), a[0].alias("amplitude_re"), a[1].alias("amplitude_im")
    )
    return out, family.join(both.select(*by, "base"), [*by, "base"])


class Places:
    """Different points of the plane with the lowest k at each, in leaves of neighbouring ones: what is
    looked for near a target is in the leaves whose boxes reach there."""

    def __init__(self, re: np.ndarray, im: np.ndarray, k: np.ndarray):
        order = np.lexsort((k, im, re))
        re, im, k = re[order], im[order], k[order]
        new = np.ones(len(k), bool)
        new[1:] = (re[1:] != re[:-1]) | (im[1:] != im[:-1])
        self.re, self.im, self.k = re[new], im[new], k[new]
        size, todo, leaves = max(32, math.isqrt(len(self.k))), [np.arange(len(self.k))] if len(k) else [], []
        while todo:
            part = todo.pop()
            if len(part) <= size:
                leaves.append(part)
                continue
            c = self.re if np.ptp(self.re[part]) >= np.ptp(self.im[part]) else self.im
            half = np.argpartition(c[part], len(part) // 2)
            todo += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        self.leaves = leaves
        self.boxes = [np.array([f(v[x]) for x in leaves]) for v in (self.re, self.im) for f in (np.min, np.max)]
        self.first = np.array([self.k[x].min() for x in leaves])

    def away(self, x: float, y: float) -> np.ndarray:
        """What a point of each leaf is away at least; rounding keeps the order."""
        left, right, low, high = self.boxes
        u, v = np.maximum(np.maximum(left - x, x - right), 0), np.maximum(np.maximum(low - y, y - high), 0)
        return np.sqrt(u * u + v * v)

    def distances(self, leaf: int, x: float, y: float) -> tuple[np.ndarray, np.ndarray]:
        at = self.leaves[leaf]
        u, v = self.re[at] - x, self.im[at] - y
        return np.sqrt(u * u + v * v), self.k[at]

    def nearest(self, x: float, y: float, reach: float) -> int | None:
        """The k of the least (distance, k), if that distance is under ``reach``."""
        away, best = self.away(x, y), (math.inf, 0)
        near = np.flatnonzero(away < reach)
        for leaf in near[np.argsort(away[near])]:
            if away[leaf] > best[0]:
                break
            d, k = self.distances(leaf, x, y)
            best = min(best, (float(d.min()), int(k[d == d.min()].min())))
        return best[1] if best[0] < reach else None

    def lowest(self, x: float, y: float, reach: float) -> int | None:
        """The lowest k nearer than ``reach``."""
        near, best = np.flatnonzero(self.away(x, y) < reach), None
        for leaf in near[np.argsort(self.first[near])]:
            if best is not None and self.first[leaf] > best:
                break
            d, k = self.distances(leaf, x, y)
            if (d < reach).any():
                found = int(k[d < reach].min())
                best = found if best is None else min(best, found)
        return best

    def family(self, re: float, im: float, tol: float, max_harmonic: int, growth: float) -> set[int]:
        """``families_of`` for a base at (re, im), without the base."""
        r, a = math.sqrt(re * re + im * im), math.atan2(im, re)
        out = {self.lowest(r * math.cos(a), -(r * math.sin(a)), tol)} if max_harmonic > 0 else set()
        for h in range(2, max_harmonic + 1):
            x, y, reach = math.pow(r, h) * math.cos(h * a), math.pow(r, h) * math.sin(h * a), tol * math.pow(growth, h - 1)
            out |= {self.nearest(x, y, reach), self.nearest(x, -y, reach)}
        return out - {None}


def harmonic_families(modes: DataFrame, by: Sequence[str], dt: float, mag_tol: float = 0.05, tol: float = 0.05, growth: float = 1.5, branch_growth: float = 1.0, max_harmonic: int = 5) -> DataFrame:
    """(keys, branch, k): all harmonic families of each key, numbered from 1; families may share modes.

    The phase mode's family comes first, then that of the slowest mode on the circle that no
    family has yet. Each tolerance is ``branch_growth`` times the last. What comes next depends on all
    that came before, so that a task walks a key's modes from the slowest on, once; it holds them, some
    tens of bytes each. Equal modes share one search."""
    by = list(by)
    modes = written(modes.select(*by, "k", "re", "im").dropna(), "modes")
    _, first = phase_and_amplitude(modes, by, dt, tol_harmonic=tol, max_harmonic=max_harmonic)
    first = first.select(*by, "k", F.lit(True).alias("phase"))
    flagged = modes.withColumn("circle", on_the_circle(mag_tol)).join(first, [*by, "k"], "left")

    def walk(group: pa.Table) -> pa.Table:
        k, re, im = (group.column(c).to_numpy() for c in ("k", "re", "im"))
        head = k[group.column("phase").is_valid().to_numpy()]
        base = np.flatnonzero(group.column("circle").to_numpy())
        base = base[np.lexsort((k[base], im[base]))]
        finite = np.isfinite(re) & np.isfinite(im)  # nothing else is near anything
        places = Places(re[finite], im[finite], k[finite])
        taken, n = set(head.tolist()), int(len(head) > 0)
        branch, members = [1] * len(head), sorted(taken)
        known: dict[tuple[float, float], set[int]] = {}
        for one, x, y in zip(k[base].tolist(), re[base].tolist(), im[base].tolist(), strict=True):
            if one in taken:
                continue
            if branch_growth != 1 or (x, y) not in known:
                known = known if branch_growth == 1 else {}
                known[x, y] = places.family(x, y, tol * math.pow(branch_growth, n), max_harmonic, growth)
            own = sorted(known[x, y] | {one})
            n += 1
            branch += [n] * len(own)
            members += own
            taken.update(own)
        same = {c: pa.repeat(group.column(c)[0], len(members)) for c in by}
        return pa.table({**same, "branch": pa.array(branch, pa.int32()), "k": pa.array(members, group.column("k").type)})

    types = dict(modes.dtypes)
    return flagged.groupBy(*by).applyInArrow(walk, ", ".join(f"`{c}` {types[c]}" for c in by) + f", branch int, k {types['k']}")
