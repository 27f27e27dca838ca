"""Small dense matrices on the driver or in Arrow batches: vech order, nearest positive matrices, gamma tails."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


def vech_pairs(k: int) -> list[tuple[int, int]]:
    """(row, column) of the lower triangle, by columns."""
    return [(i, j) for j in range(k) for i in range(j, k)]


def vech(m: np.ndarray) -> np.ndarray:
    return np.array([m[i, j] for i, j in vech_pairs(len(m))])


def unvech(v: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for x, (i, j) in zip(v, vech_pairs(k), strict=True):
        m[i, j] = m[j, i] = x
    return m


@dataclass
class CovStruct:
    """Genetic covariance S, its sampling covariance V (of vech S), intercepts I, sample sizes N and variant count m."""

    s: np.ndarray
    v: np.ndarray
    i: np.ndarray
    names: list[str] = field(default_factory=list)
    n: np.ndarray | None = None
    m: float = 1.0

    def __post_init__(self):
        self.names = self.names or [f"V{j + 1}" for j in range(len(self.s))]

    def standardized(self) -> tuple[np.ndarray, np.ndarray]:
        """Genetic correlations and their sampling covariance; every variance must be positive."""
        d = np.diag(self.s)
        if (d <= 0).any():
            raise ValueError("standardizing needs positive variances")
        scale = vech(1 / np.sqrt(np.outer(d, d)))
        return self.s / np.sqrt(np.outer(d, d)), self.v * np.outer(scale, scale)

    def subset(self, keep: list[str]) -> CovStruct:
        at = [self.names.index(x) for x in keep]
        order = {p: n for n, p in enumerate(vech_pairs(len(self.s)))}
        rows = [order[max(at[i], at[j]), min(at[i], at[j])] for i, j in vech_pairs(len(at))]
        return CovStruct(self.s[np.ix_(at, at)], self.v[np.ix_(rows, rows)], self.i[np.ix_(at, at)], list(keep), None, self.m)


def nearest_positive(m: np.ndarray, corr: bool = False, steps: int = 100) -> np.ndarray:
    """Alternating projections with a correction onto positive semidefinite matrices (and unit diagonals)."""
    x, fix = m.copy(), np.zeros_like(m)
    for _ in range(steps):
        r = x - fix
        w, q = np.linalg.eigh(r)
        w[w < 1e-6 * max(w.max(), 0)] = 0
        y = (q * w) @ q.T
        fix = y - r
        new = y.copy()
        if corr:
            np.fill_diagonal(new, 1)
        done = np.abs(new - x).sum(1).max() <= 1e-7 * max(np.abs(x).sum(1).max(), 1e-300)
        x = new
        if done:
            break
    w, q = np.linalg.eigh(x)
    floor = 1e-8 * abs(w.max())
    if w.min() < floor:
        old = np.diag(x).copy()
        x = (q * np.maximum(w, floor)) @ q.T
        scale = np.sqrt(np.maximum(old, floor) / np.diag(x))
        x = x * np.outer(scale, scale)
    return x


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared by the incomplete gamma function: a series or a continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0 or not math.isfinite(x):
        return 1.0 if x <= 0 else 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
