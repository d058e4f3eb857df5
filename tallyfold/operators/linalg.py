"""Least squares in numpy, for groups that fit into a task."""

from __future__ import annotations

import math

import numpy as np


def residuals(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y less its projection on the columns of x, over complete rows; NaN elsewhere. The minimum-norm solution for collinear columns."""
    out = np.full(len(y), np.nan)
    ok = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
    if ok.any():
        out[ok] = y[ok] - x[ok] @ np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 and math.isinf(t) else math.nan)


def solved(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, t-values and p-values of n rows, or of a triangle that stands for them. A singular problem gives 0 and NaN; without spare rows t and p are NaN."""
    k = x.shape[1]
    none = np.full(k, np.nan)
    scale = np.linalg.norm(x, 2) if x.size else 0.0
    if n == 0 or np.linalg.matrix_rank(x, tol=scale * max(n, k) * np.finfo(float).eps) < min(k, n):
        return np.zeros(k), none, none
    beta = np.linalg.lstsq(x, y, rcond=np.finfo(float).eps * max(n, k))[0]
    spare = n - k
    if spare <= 0:
        return beta, none, none
    rest = y - x @ beta
    var = rest @ rest / spare * np.diag(np.linalg.inv(x.T @ x))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / np.sqrt(var)
    return beta, t, np.array([student_p(v, spare) for v in t])


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, constant first, and p-values over complete rows."""
    ok = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
    beta, _, p = solved(np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok], int(ok.sum()))
    return beta, p
