"""Limited-memory BFGS with a strong-Wolfe line search."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Minimum(NamedTuple):
    x: np.ndarray
    value: float
    iterations: int
    converged: bool
    message: str


def _line_search(f, x, value, g, d, c1=1e-4, c2=0.9, tries=40):
    """Step that decreases enough and flattens the slope; bracketing, then halving between the ends."""
    slope, low, high, step = float(g @ d), 0.0, np.inf, 1.0
    best = None
    for _ in range(tries):
        point = x + step * d
        v, ng = f(point)
        if not np.isfinite(v) or v > value + c1 * step * slope:
            high = step
        else:
            if best is None or v < best[1]:
                best = (point, v, ng)
            now = float(ng @ d)
            if abs(now) <= -c2 * slope:
                return point, v, ng
            if now > 0:
                high = step
            else:
                low = step
        step = 2 * step if high == np.inf else 0.5 * (low + high)
    return best


def minimize(f, x0: np.ndarray, *, tol: float = 1e-6, progress: float = 1e-9, max_iter: int = 2000, memory: int = 100) -> Minimum:
    """f(x) -> (value, gradient). Ends when the gradient or the relative decrease is small."""
    x = np.array(x0, dtype=float)
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for it in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tol:
            return Minimum(x, value, it, True, "small gradient")
        d, alphas = -g, []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ d)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - rho * (y @ d)) * s
        if g @ d >= 0:
            d, pairs = -g, []
        found = _line_search(f, x, value, g, d)
        if found is None:
            if pairs:
                pairs = []
                continue
            return Minimum(x, value, it, np.abs(g).max(initial=0.0) <= 1e3 * tol, "no descent along the gradient")
        nx, nv, ng = found
        s, y = nx - x, ng - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        drop = value - nv
        x, value, g = nx, nv, ng
        if drop <= progress * max(abs(value), 1.0) * 1e-3 or drop <= np.finfo(float).eps * abs(value):
            return Minimum(x, value, it + 1, True, "small decrease")
    return Minimum(x, value, max_iter, False, "iteration cap (optimizer_max_iter)")
