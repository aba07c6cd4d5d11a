"""Features whose products are Gaussian kernel values to rounding, for points in a box of few widths.

Along one coordinate the kernel is interpolated between Chebyshev nodes, whose error is known before
(an analytic function on an ellipse around the box), and the matrix between nodes is cut where its
eigenvalues end in rounding. The kernel is the product of its coordinates' kernels, so that its features
are the products of theirs. Their number follows the box's size in widths, never the rows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

#: Features, at most, and coordinates and nodes of one that are tried.
MAX_RANK, MAX_DIM, MAX_NODES = 1024, 3, 160
#: What a kernel value may be off, about.
OFF = 1e-16


def nodes_for(half: float) -> int:
    """Nodes that interpolate exp(-(x - y)^2 / 2) on [-half, half] in x, for any y, to OFF."""
    if half == 0:
        return 1
    rho = 1 + np.geomspace(1e-3, 1e3, 400)
    tall = np.log(4) + (half * (rho - 1 / rho) / 2) ** 2 / 2 - np.log(rho - 1)
    return next((n for n in range(2, MAX_NODES + 1) if (tall - n * np.log(rho)).min() <= np.log(OFF)), MAX_NODES + 1)


@dataclass(frozen=True)
class NodeFeatures:
    """``halves``: of each coordinate, from Chebyshev polynomials to its features; ``picks``: which of each
    coordinate's features make a feature (coordinates, rank)."""

    low: np.ndarray
    high: np.ndarray
    halves: tuple[np.ndarray, ...]
    picks: np.ndarray

    @property
    def rank(self) -> int:
        return self.picks.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, rank): a row's products with another's are the kernel of the two."""
        out = np.ones((len(x), self.rank))
        for c, half in enumerate(self.halves):
            wide = self.high[c] - self.low[c]
            t = np.clip((2 * x[:, c] - self.low[c] - self.high[c]) / wide, -1, 1) if wide > 0 else np.zeros(len(x))
            out *= (np.polynomial.chebyshev.chebvander(t, len(half) - 1) @ half)[:, self.picks[c]]
        return out


def node_features(low: np.ndarray, high: np.ndarray, sigma: float) -> NodeFeatures | None:
    """Features for points of the box, or None where MAX_RANK are too few."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    if not 0 < len(low) <= MAX_DIM or not (np.isfinite(low) & np.isfinite(high)).all() or sigma <= 0:
        return None
    halves, spectra = [], []
    for a, b in zip(low, high, strict=True):
        n = nodes_for(float(b - a) / 2 / sigma)
        if n > MAX_NODES:
            return None
        k = np.arange(n)
        at = np.cos(np.pi * (k + 0.5) / n)
        place = at * (b - a) / 2 / sigma
        value, vector = np.linalg.eigh(np.exp(-((place[:, None] - place[None]) ** 2) / 2))
        keep = value > OFF * value[-1]
        # values at nodes to Chebyshev coefficients
        to = np.cos(np.pi * np.outer(k, k + 0.5) / n) * (2 / n)
        to[0] /= 2
        halves.append(to @ vector[:, keep][:, ::-1] * np.sqrt(value[keep][::-1]))
        spectra.append(value[keep][::-1] / value[-1])
    if np.prod([len(s) for s in spectra]) > 64 * MAX_RANK:
        return None
    picks = np.array(list(product(*[range(len(s)) for s in spectra]))).T
    picks = picks[:, np.prod([s[p] for s, p in zip(spectra, picks, strict=True)], 0) > OFF]
    return NodeFeatures(low, high, tuple(halves), picks) if picks.shape[1] <= MAX_RANK else None
