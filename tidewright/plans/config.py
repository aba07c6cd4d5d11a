"""Whole analyses: one configuration, one result, dispatch on the kind of dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.lifts import Fourier, Hermite, Radial, cluster_centers, lift
from tidewright.functions.vectors import matrix_table, spectrum_table
from tidewright.operators import fit, predict, spectral, stats
from tidewright.operators.embedding import central_difference, delay_embed, snapshot_pairs
from tidewright.operators.hankel_gram import hankel_axes
from tidewright.shared import remove, write_once

KINDS = ("hermite", "rbf", "rff", "none", "kernel", "havok")


@dataclass(frozen=True)
class Config:
    """Settings of an analysis; checked and lower-cased when made."""

    m_embed: int = 5000
    tau_delay: int = 10
    r: int | None = 100
    use_svd: bool = True
    dict_type: str = "rbf"
    dict_params: dict[str, Any] = field(default_factory=lambda: {"n_rbf": 500, "include_states": True})
    edmd_method: str = "ridge"
    edmd_alpha: float = 1e-2
    proj_alpha: float = 1e-6
    dt: float = 0.1
    return_psi: bool = True
    verbose: bool = True
    parallel: bool = True
    seed: int | None = None
    #: How the leading axes are found: ``qr``, or ``gram``, the structured sums of a series, which
    #: suit thousands of delays and lose axes below about 1e-8 of the first.
    axes: str = "qr"

    def __post_init__(self):
        object.__setattr__(self, "dict_type", str(self.dict_type).lower())
        object.__setattr__(self, "edmd_method", str(self.edmd_method).lower())
        self.validate()

    def validate(self) -> Config:
        for name, ok in (
            ("m_embed", self.m_embed > 0), ("tau_delay", self.tau_delay > 0), ("dt", self.dt > 0), ("edmd_alpha", self.edmd_alpha >= 0),
            ("proj_alpha", self.proj_alpha >= 0), ("r", self.r is None or self.r > 0), ("dict_type", self.dict_type in KINDS),
            ("edmd_method", self.edmd_method in ("pinv", "ridge")), ("axes", self.axes in ("qr", "gram")),
        ):
            if not ok:
                raise ValueError(f"{name} can't be {getattr(self, name)!r}")
        return self


@dataclass
class Analysis:
    """A learned operator. ``convention`` tells how it acts: ``features`` (psi <- K' psi) or
    ``delays`` (s <- K s)."""

    config: Config
    k: np.ndarray
    b: np.ndarray | None
    b_reduced: np.ndarray | None
    u: np.ndarray | None
    convention: str
    states: DataFrame | None
    dictionary: Any = None
    kernel: fit.KernelFit | None = None
    forcing: tuple[np.ndarray, np.ndarray] | None = None
    sigma: np.ndarray | None = None
    #: Shared folders of what the fit has written.
    held: list[str] = field(default_factory=list)

    @cached_property
    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        return spectral.spectrum_of(self.k, howmany=10_000)

    def operator_table(self, spark) -> DataFrame:
        return matrix_table(spark, self.k)

    def spectrum_table(self, spark, howmany: int = 200) -> DataFrame:
        values, vectors = self.spectrum
        return spectrum_table(spark, values[:howmany], vectors[:, :howmany])

    def release(self, spark) -> None:
        """Removes what the fit has written: the series and the reduced states. Frames that read
        them can't be evaluated any more."""
        for path in self.held:
            remove(spark, path)
        self.held.clear()

    def harmonic_branches(self, **options) -> dict[int, list[int]]:
        return spectral.harmonic_branches(self.spectrum[0], self.config.dt, **options)

    def predict(self, starts: Sequence[int] | None, n_pred: int) -> DataFrame:
        """(start_idx, step, dim, x_true, x_pred) of the observable s[0]; None starts from every row
        that has ``n_pred`` rows after it."""
        if self.states is None:
            raise ValueError("a fit on states has no delay vectors: use operators.predict")
        if self.kernel is not None:
            return predict.predict_kernel(self.states, self.kernel, self.u, starts, n_pred)
        if self.forcing is not None:
            return predict.predict_forced(self.states, *self.forcing, self.u, starts, n_pred, self.config.dt)
        if self.convention == "delays":
            return predict.predict_delay_space(self.states, self.k, starts, n_pred)
        x = fit.projected(self.states, self.u) if self.u is not None else self.states.withColumn("x", F.col("s"))
        return predict.predict_from_psi(lift(x, self.dictionary), self.k, self.b, starts, n_pred)


def embed(series: DataFrame, config: Config) -> DataFrame:
    """Delay vectors (t, s) of one series (t, value)."""
    return delay_embed(series, config.m_embed, config.tau_delay, [])


def dictionary_for(config: Config, x: DataFrame, dim: int, key: str = "t") -> Any:
    """The configured dictionary on states ``x`` (an array column ``x``)."""
    p, seed = dict(config.dict_params), config.seed or 0
    if config.dict_type == "hermite":
        return Hermite(dim, p.get("max_deg", 2), p.get("basis_type", "probabilist"))
    if config.dict_type == "rff":
        return Fourier.random(dim, p.get("D", 500), p.get("sigma", 1.0), p.get("include_states", False), p.get("seed", seed))
    if config.dict_type == "rbf":
        moments = None
        if p.get("normalize", False):
            x, moments = stats.normalize_states(x)
        centers = p.get("centers") or cluster_centers(x, p.get("n_rbf", 200), "x", p.get("max_points"), p.get("seed", seed), key)
        kernel, sigma = p.get("kernel_type", "thinplate"), p.get("sigma")
        if kernel == "gaussian" and sigma in (None, "auto"):
            sigma = stats.median_sigma(x, "x", key, seed=seed)
        return Radial(
            tuple(tuple(map(float, c)) for c in centers), kernel, sigma if kernel == "gaussian" else None, p.get("include_states", True),
            tuple(p["state_indices"]) if p.get("state_indices") is not None else None, tuple(moments) if moments else None,
        )
    raise ValueError(f"no dictionary of kind {config.dict_type!r}")


def fitted(config: Config, pairs: DataFrame, d: Any) -> tuple[np.ndarray, np.ndarray]:
    """(K, B) of snapshot pairs under a dictionary; a polynomial's B is its selector."""
    lifted = fit.lifted_pairs(pairs, d)
    k = fit.fit_operator(lifted, config.edmd_method, config.edmd_alpha, size=(d.size, d.size))
    b = d.projection() if isinstance(d, Hermite) else fit.fit_projection(lifted, "x", "psi_x", config.proj_alpha, size=(d.dim, d.size))
    return k, b


def hankel_analysis(series: DataFrame, config: Config) -> Analysis:
    """Of one series (t, value): t = 1, 2, ... The series, two numbers a row, is written once for the
    passes over it; its delay vectors are made anew in each. ``release`` removes it."""
    series, path = write_once(series.select("t", "value"), "series")
    axes = None
    if config.dict_type == "havok" or (config.axes == "gram" and (config.use_svd or config.dict_type == "none")):
        axes = hankel_axes(series, config.m_embed, config.tau_delay)
    out = delay_analysis(embed(series, config), config, axes)
    out.held.append(path)
    return out


def delay_analysis(states: DataFrame, config: Config, axes: tuple[np.ndarray, np.ndarray, int] | None = None) -> Analysis:
    """Of delay vectors (t, s). ``axes``: their principal axes, singular values and number, if known."""
    kind = config.dict_type
    if kind == "havok":
        return forced_analysis(states, config, axes)
    u, sigma = (axes[:2] if axes else fit.principal_axes(states)) if config.use_svd or kind == "none" else (None, None)
    held = []
    if u is not None:
        r = min(config.r or u.shape[1], u.shape[1])
        u, sigma = u[:, :r], sigma[:r]
        # r numbers a row: written, so that the fits don't embed and project again
        reduced, path = write_once(fit.projected(states, u).select("t", "x"), "reduced")
        held.append(path)
    else:
        reduced = states.select("t", F.col("s").alias("x"))
    pairs = snapshot_pairs(reduced, [])
    if kind == "none":
        # y ~ K x on the reduced coordinates, brought back to the delay vectors
        small = fit.fit_operator(pairs, "pinv", x="x", y="y").T
        return Analysis(config, u @ small @ u.T, u.T, np.eye(len(small)), u, "delays", states, sigma=sigma, held=held)
    if kind == "kernel":
        p = config.dict_params
        alpha, seed = p.get("alpha", 1e-6), p.get("seed", config.seed or 0)
        if p.get("n_landmarks"):  # all pairs
            f = fit.fit_landmarks(pairs, p.get("sigma", 1.0), p["n_landmarks"], alpha, seed)
        else:  # the reference's: the pairs, or a sample of them, are the basis
            f = fit.fit_kernel(pairs, p.get("sigma", 1.0), alpha, p.get("n_subsample"), seed)
        axes = u if u is not None else np.eye(f.landmarks.shape[1])
        return Analysis(config, f.k, axes @ f.b, f.b, axes, "features", states, kernel=f, sigma=sigma, held=held)
    (dim,) = fit.widths(reduced, "x")
    d = dictionary_for(config, reduced.select("t", "x"), dim)
    k, b = fitted(config, pairs, d)
    return Analysis(config, k, u @ b if u is not None else b, b, u, "features", states, d, sigma=sigma, held=held)


def forced_analysis(states: DataFrame, config: Config, axes: tuple[np.ndarray, np.ndarray, int] | None = None) -> Analysis:
    """Linear dynamics of the leading coordinates, forced by the last one."""
    p = config.dict_params
    u, sigma, n = axes or (*fit.principal_axes_by_gram(states), states.count())
    method = p.get("rank_method", "energy")
    aspect = len(u) / n
    r = stats.select_rank(sigma, method, p.get("energy", 0.999), aspect) if config.r is None else min(config.r, len(sigma))
    r = min(r, n)
    if r < 2:
        raise ValueError("a forced fit needs rank 2 or more")
    u = u[:, :r]
    v, path = write_once(fit.projected(states, u).select("t", "x"), "reduced")
    lead = v.select("t", F.slice("x", 1, r - 1).alias("lead"))
    rates = central_difference(lead, config.dt, [], "lead").withColumnRenamed("derivative", "rate")
    rows = v.select("t", "x").join(rates, "t").select("x", "rate")
    ridge = p.get("ridge_alpha", 0.0)
    ab = fit.fit_operator(rows, "ridge" if ridge > 0 else "pinv", ridge, "x", "rate").T
    a, b = ab[:, : r - 1], ab[:, r - 1]
    whole = np.zeros((r, r))
    whole[: r - 1] = ab
    return Analysis(config, fit.expm(whole * config.dt), u, None, u, "delays", states, forcing=(a, b), sigma=sigma, held=[path])


def state_analysis(pairs: DataFrame, config: Config, key: str = "t") -> Analysis:
    """Of snapshot pairs (.., x, y), without embedding: polynomial, radial or Fourier."""
    if config.dict_type not in ("hermite", "rbf", "rff"):
        raise ValueError(f"states are fitted with hermite, rbf or rff, not {config.dict_type!r}")
    (dim,) = fit.widths(pairs, "x")
    d = dictionary_for(config, pairs.select(key, "x"), dim, key)
    k, b = fitted(config, pairs, d)
    return Analysis(config, k, b, b, None, "features", None, d)
