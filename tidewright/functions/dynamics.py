"""Vector fields of the built-in systems, their parameters, regimes and fixed points.

A drift is written once over a list of coordinates and works on Spark columns and on NumPy
arrays alike; ``columns`` and ``arrays`` are the two sets of elementary functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

columns = SimpleNamespace(
    sqrt=F.sqrt, cos=F.cos, sin=F.sin, acos=F.acos, atan2=F.atan2, abs=F.abs, cbrt=F.cbrt,
    clip=lambda x, a, b: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), x)),
    where=lambda c, a, b: F.when(c, a).otherwise(b),
)
arrays = SimpleNamespace(sqrt=np.sqrt, cos=np.cos, sin=np.sin, acos=np.arccos, atan2=np.arctan2, abs=np.abs, cbrt=np.cbrt, clip=np.clip, where=np.where)

Drift = Callable[[Sequence[Any], dict[str, Any], SimpleNamespace], list[Any]]


def fhn(x, p, m):
    v, w = x
    return [v - v * v * v / 3.0 - w + p["I"], p["eps"] * (v + p["a"] - p["b"] * w)]


def duffing(x, p, m):
    q, v = x
    return [v, -p["delta"] * v - p["beta"] * q - p["alpha"] * q * q * q]


def lorenz(x, p, m):
    a, b, c = x
    return [p["sigma"] * (b - a), a * (p["rho"] - c) - b, a * b - p["beta"] * c]


def vanderpol(x, p, m):
    a, b, c = x
    return [b, c, p["mu"] * (1.0 - a * a) * c - a - b]


def rossler(x, p, m):
    a, b, c = x
    return [-b - c, a + p["a"] * b, p["b"] + c * (a - p["c"])]


def largest_root(mu2, mu1, m):
    """The largest real root of x^3 - mu2 x - mu1 in closed form: by cosine where there are
    three roots, by cube roots where there is one."""
    disc = mu1 * mu1 / 4.0 - mu2 * mu2 * mu2 / 27.0
    r = m.sqrt(m.where(mu2 > 0, mu2, 0.0 * mu2) / 3.0)
    safe = m.where(r > 0, r, 0.0 * r + 1.0)
    three = 2.0 * r * m.cos(m.acos(m.clip(mu1 / (2.0 * safe * safe * safe), -1.0, 1.0)) / 3.0)
    s = m.sqrt(m.where(disc > 0, disc, 0.0 * disc))
    one = m.cbrt(mu1 / 2.0 + s) + m.cbrt(mu1 / 2.0 - s)
    return m.where(disc > 0, one, three)


def path_parameters(z, a, b, radius, m):
    """(mu2, mu1, nu, theta, phi) at z on the straight line from ``a`` to ``b``, moved out to the
    sphere of that radius; a and b hold -mu1 in the second place."""
    q = [a[i] + z * (b[i] - a[i]) for i in range(3)]
    r = m.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    far = r > 1e-12
    scale = m.where(far, radius / m.where(far, r, 0.0 * r + 1.0), 0.0 * r + 1.0)
    q = [v * scale for v in q]
    return q[0], -q[1], q[2], m.acos(m.clip(q[2] / radius, -1.0, 1.0)), m.atan2(q[1], q[0])


def epileptor3d(x, p, m):
    a, b, c = x
    line = [[p[f"{e}{i}"] for i in (1, 2, 3)] for e in "AB"]
    mu2, mu1, nu, _, _ = path_parameters(c, *line, p["R"], m)
    xs = largest_root(mu2, mu1, m)
    far = m.sqrt((a - xs) * (a - xs) + b * b)
    return [-b, a * a * a - mu2 * a - mu1 - b * (nu + a + a * a), -p["c"] * (far - p["dstar"])]


def epileptor_amplitude(x, p, m):
    line = [[p[f"{e}{i}"] for i in (1, 2, 3)] for e in "AB"]
    mu2, mu1, _, _, _ = path_parameters(x[2], *line, p["R"], m)
    return m.abs(x[0] - largest_root(mu2, mu1, m))


@dataclass(frozen=True)
class System:
    name: str
    dim: int
    drift: Drift
    mask: tuple[float, ...]
    #: amplitude of state-dependent noise for each coordinate
    amplitude: Callable[..., list[Any]]


def first_abs(x, p, m):
    return [m.abs(x[0])] * len(x)


def each_abs(x, p, m):
    return [m.abs(v) for v in x]


SYSTEMS: dict[str, System] = {
    s.name: s
    for s in (
        System("fhn", 2, fhn, (1.0, 0.0), first_abs),
        System("duffing", 2, duffing, (1.0, 0.0), first_abs),
        System("epileptor3d", 3, epileptor3d, (1.0, 0.0, 0.0), lambda x, p, m: [epileptor_amplitude(x, p, m)] * 3),
        System("lorenz", 3, lorenz, (1.0, 1.0, 1.0), each_abs),
        System("vanderpol", 3, vanderpol, (1.0, 0.0, 0.0), first_abs),
        System("rossler", 3, rossler, (1.0, 1.0, 1.0), each_abs),
    )
}


@dataclass(frozen=True)
class Parameters:
    """A system with values and its noise: ``none``, ``additive`` or ``state_dependent``."""

    system: str
    values: dict[str, float]
    noise_type: str = "none"
    sigma: float = 0.0
    noise_mask: tuple[float, ...] = field(default=())

    def __post_init__(self):
        if self.noise_type not in ("none", "additive", "state_dependent"):
            raise ValueError(f"unknown noise type {self.noise_type!r}")
        if not self.noise_mask:
            object.__setattr__(self, "noise_mask", SYSTEMS[self.system].mask)

    @property
    def dim(self) -> int:
        return SYSTEMS[self.system].dim

    def drift(self, x: Sequence[Any], m: SimpleNamespace = arrays) -> list[Any]:
        return SYSTEMS[self.system].drift(x, self.values, m)

    def diffusion(self, x: Sequence[Any], m: SimpleNamespace = arrays) -> list[Any]:
        if self.noise_type == "none":
            return [0.0 * v for v in x]
        if self.noise_type == "additive":
            return [0.0 * v + self.sigma * w for v, w in zip(x, self.noise_mask, strict=True)]
        amp = SYSTEMS[self.system].amplitude(x, self.values, m)
        return [self.sigma * a * w for a, w in zip(amp, self.noise_mask, strict=True)]


def drift_column(p: Parameters, x: Column) -> Column:
    """The drift at an ``array<double>`` state, as an array."""
    return F.array(*p.drift([F.get(x, F.lit(i)) for i in range(p.dim)], columns))


def diffusion_column(p: Parameters, x: Column) -> Column:
    return F.array(*p.diffusion([F.get(x, F.lit(i)) for i in range(p.dim)], columns))


# --- regimes ------------------------------------------------------------------------------

# The parameters of each regime, and the shown names of systems and regimes.
REGIMES: dict[str, dict[str, dict[str, float]]] = {
    "fhn": {
        "stable-limit-cycle": {"a": 0.7, "b": 0.0, "eps": 0.08, "I": 0.5},
        "stable-node": {"a": 0.7, "b": 0.8, "eps": 0.08, "I": -0.4},
        "three-equilibrium-regime": {"a": 0.7, "b": 0.8, "eps": 0.08, "I": 0.32},
    },
    "duffing": {
        "stable-node": {"delta": 0.3, "beta": 1.0, "alpha": -1.0},
        "three-equilibrium-attractors": {"delta": 0.2, "beta": -1.0, "alpha": 1.0},
        "three-equilibrium-centers": {"delta": 0.0, "beta": -1.0, "alpha": 1.0},
    },
    "epileptor3d": {
        name: dict(zip(("A1", "A2", "A3", "B1", "B2", "B3", "c"), values, strict=True)) | {"R": 0.4, "dstar": 0.3, "tau0": 1.0}
        for name, values in {
            "c2s-SN-SH": (0.0, 0.0, -0.5, 0.24, 0.09, -0.34, 0.01),
            "c3s-SN-supH": (0.0, 0.0, -0.5, 0.2636, 0.0909, -0.3182, 0.01),
            "c10s-supH-SH": (0.0727, 0.0, -0.4273, 0.3273, 0.0, -0.2273, 0.01),
            "c11s-supH-supH": (0.1091, 0.0, -0.3909, 0.3636, 0.0, -0.1909, 0.01),
            "c2b-SN-SH": (0.0, 0.0, -0.5, 0.16, 0.1, -0.38, 0.02),
            "c4b-SN-FLC": (0.1871, -0.0251, -0.3526, 0.3072, 0.0655, -0.2476, 0.02),
            "c14b-subH-SH": (0.0873, -0.0524, -0.4413, 0.24, 0.03, -0.33, 0.02),
            "c16b-subH-FLC": (0.1091, -0.03, -0.4182, 0.2727, 0.05, -0.3, 0.02),
        }.items()
    },
    "lorenz": {"chaotic": {"sigma": 10.0, "rho": 28.0, "beta": 8.0 / 3.0}},
    "vanderpol": {"stable-focus": {"mu": -2.0}, "stable-limit-cycle": {"mu": 0.3}, "chaotic": {"mu": 0.58}},
    "rossler": {"stable-limit-cycle": {"a": 0.2, "b": 0.2, "c": 2.5}, "chaotic": {"a": 0.2, "b": 0.2, "c": 5.7}},
}
LABELS = {"fhn": "FHN", "duffing": "Duffing", "epileptor3d": "Epileptor3D", "lorenz": "Lorenz", "vanderpol": "VanderPol", "rossler": "Rossler"}
TITLES = {"fhn": "FHN", "duffing": "Duffing", "epileptor3d": "Epileptor 3D", "lorenz": "Lorenz", "vanderpol": "Van der Pol (3rd order)", "rossler": "Rössler"}
SHOWN = {
    "stable-limit-cycle": "stable limit cycle", "stable-node": "stable node", "three-equilibrium-regime": "three-equilibrium regime",
    "three-equilibrium-attractors": "three attractors", "three-equilibrium-centers": "three centers", "chaotic": "chaotic", "stable-focus": "stable focus",
}


def known(system: str) -> str:
    name = system.lower().replace("-", "").replace("_", "")
    if name not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}")
    return name


def parameters(system: str, regime: str, noise_type: str = "none", sigma: float = 0.0, noise_mask: Sequence[float] = ()) -> Parameters:
    name = known(system)
    if regime not in REGIMES[name]:
        raise ValueError(f"unknown regime {regime!r} of {name}")
    return Parameters(name, REGIMES[name][regime], noise_type, float(sigma), tuple(map(float, noise_mask)))


@dataclass(frozen=True)
class RegimeConfig:
    system: str
    regime: str
    regime_name: str
    suffix: str
    params: Parameters
    save_dir: str


def suffix_of(system: str, regime: str) -> str:
    """The regime's name in paths: Epileptor regimes stand as they are."""
    if known(system) == "epileptor3d":
        return regime
    short = "limit-cycle" if regime == "stable-limit-cycle" else regime.removesuffix("-regime")
    return f"{short}-regime"


def default_save_dir(system: str, regime: str, base_dir: str = ".", subdir: str = "Results") -> str:
    return f"{base_dir.rstrip('/')}/{subdir}/{LABELS[known(system)]}-{suffix_of(system, regime)}"


def regime_config(system: str, regime: str, save_dir: str | None = None) -> RegimeConfig:
    p = parameters(system, regime)
    shown = "chaotic attractor" if (p.system, regime) == ("rossler", "chaotic") else SHOWN.get(regime, regime)
    return RegimeConfig(p.system, regime, f"{TITLES[p.system]} — {shown}", suffix_of(system, regime), p, save_dir or default_save_dir(system, regime))


def list_regimes(system: str) -> list[str]:
    """Empty for an unknown system."""
    return list(REGIMES.get(system.lower(), {}))


def regimes_table(spark: SparkSession) -> DataFrame:
    """The catalogue as rows: system, regime, regime_name, suffix, params, save_dir."""
    rows = [regime_config(s, r) for s in REGIMES for r in REGIMES[s]]
    return spark.createDataFrame(
        [(c.system, c.regime, c.regime_name, c.suffix, c.params.values, c.save_dir) for c in rows],
        "system string, regime string, regime_name string, suffix string, params map<string,double>, save_dir string",
    )


# --- fixed points -------------------------------------------------------------------------


def cubic_roots(p: float, q: float, low: float, high: float) -> list[float]:
    """Real roots of v^3 + p v + q inside [low, high], ascending."""
    roots = np.roots([1.0, 0.0, p, q])
    real = sorted(float(r.real) for r in roots if abs(r.imag) < 1e-9)
    return [r for i, r in enumerate(real) if low <= r <= high and (i == 0 or r - real[i - 1] > 1e-12)]


def fixed_points(p: Parameters) -> list[tuple[float, ...]]:
    """All fixed points of a system, in the order of ``fixed_point``'s choice. The Epileptor has
    none in closed form."""
    v = p.values
    if p.system == "fhn":
        if v["b"] == 0:
            x = -v["a"]
            return [(x, x - x**3 / 3 + v["I"])]
        # v - v^3/3 - (v + a)/b + I = 0
        return [(x, (x + v["a"]) / v["b"]) for x in cubic_roots(3 * (1 / v["b"] - 1), 3 * (v["a"] / v["b"] - v["I"]), -3, 3)]
    if p.system == "duffing":
        out = [(0.0, 0.0)]
        if v["alpha"] * v["beta"] < 0:
            r = float(np.sqrt(-v["beta"] / v["alpha"]))
            out += [(r, 0.0), (-r, 0.0)]
        return out
    if p.system == "lorenz":
        out = [(0.0, 0.0, 0.0)]
        if v["rho"] > 1:
            r = float(np.sqrt(v["beta"] * (v["rho"] - 1)))
            out += [(r, r, v["rho"] - 1), (-r, -r, v["rho"] - 1)]
        return out
    if p.system == "vanderpol":
        return [(0.0, 0.0, 0.0)]
    if p.system == "rossler":
        disc = v["c"] ** 2 - 4 * v["a"] * v["b"]
        if disc < 0:
            return []
        ys = sorted({(-v["c"] + s * float(np.sqrt(disc))) / (2 * v["a"]) for s in (1, -1)}, reverse=True)
        return [(-v["a"] * y, y, -y) for y in ys]
    return []


def fixed_point(p: Parameters) -> tuple[float, ...]:
    """The first fixed point; for the Epileptor the upper state of its fast part at z = 0."""
    if p.system == "epileptor3d":
        line = [[p.values[f"{e}{i}"] for i in (1, 2, 3)] for e in "AB"]
        mu2, mu1, _, _, _ = path_parameters(np.float64(0), *line, p.values["R"], arrays)
        return (float(largest_root(mu2, mu1, arrays)), 0.0, 0.0)
    found = fixed_points(p)
    if not found:
        raise ValueError(f"{p.system} has no fixed point at these values")
    return found[0]


def fixed_points_table(spark: SparkSession) -> DataFrame:
    """(system, regime, k, x) for every regime of the catalogue, k from 1."""
    rows = []
    for s in REGIMES:
        for r in REGIMES[s]:
            p = parameters(s, r)
            found = [fixed_point(p)] if s == "epileptor3d" else fixed_points(p)
            rows += [(s, r, k + 1, list(map(float, x))) for k, x in enumerate(found)]
    return spark.createDataFrame(rows, "system string, regime string, k int, x array<double>")


def with_values(p: Parameters, **values: float) -> Parameters:
    return replace(p, values={**p.values, **values})
