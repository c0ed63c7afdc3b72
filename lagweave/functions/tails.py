"""Tail probabilities on numpy arrays."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution; 1 for a value that isn't a positive number."""
    return 1.0 if not f > 0 or d1 <= 0 or d2 <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def hypergeom_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) of marked ones among the drawn."""
    low, high = max(k, drawn + marked - total, 0), min(marked, drawn)
    log_c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return min(1.0, sum(math.exp(log_c(marked, i) + log_c(total - marked, drawn - i) - log_c(total, drawn)) for i in range(low, high + 1)))


def gpd_fit(excess: np.ndarray) -> tuple[float, float] | None:
    """(shape, scale) of a generalised Pareto distribution by profile likelihood over shape / scale.

    None with under 10 values, a scale of 0 or less, or a shape over 0.5 in size.
    """
    x = excess[excess > 0]
    if len(x) < 10:
        return None
    top = x.max()
    grid = np.concatenate([-np.geomspace(1e-4, 0.999, 200) / top, np.geomspace(1e-4, 20, 200) / x.mean()])
    shapes = np.log1p(grid[:, None] * x[None]).mean(1)
    scales = shapes / grid
    ok = (scales > 0) & (np.abs(shapes) > 1e-12)
    like = np.where(ok, -np.log(np.where(ok, scales, 1.0)) - 1 - shapes, -np.inf)
    k = int(np.argmax(like))
    return (float(shapes[k]), float(scales[k])) if np.isfinite(like[k]) and abs(shapes[k]) <= 0.5 else None


def gpd_sf(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    return np.maximum(1 + shape * np.maximum(x, 0) / scale, 0) ** (-1 / shape)
