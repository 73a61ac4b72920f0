"""Special functions: erf and log-gamma as column expressions, the regularised gamma and its inverse by Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Cody's rational approximations of erf (|x| <= 0.46875) and erfc (up to 4, and beyond), highest power first.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
MID_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_Q = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
# Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner's rule, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def erf(x: Column) -> Column:
    a = F.abs(x)
    square = x * x
    near = x * polynomial(square, ERF_P) / polynomial(square, ERF_Q)
    middle = F.exp(-square) * polynomial(a, MID_P) / polynomial(a, MID_Q)
    inverse = F.lit(1.0) / F.greatest(square, F.lit(16.0))
    tail = inverse * polynomial(inverse, FAR_P) / polynomial(inverse, FAR_Q)
    far = F.exp(-square) / F.greatest(a, F.lit(4.0)) * (F.lit(1 / math.sqrt(math.pi)) - tail)
    beyond = F.lit(1.0) - F.when(a <= 4.0, middle).otherwise(far)
    return F.when(a <= 0.46875, near).otherwise(F.signum(x) * beyond)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) of x > 0, by shifting x up by one."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + F.lit(float(k)))
    t = x + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(total) - F.ln(x)


def _log_gamma(s: np.ndarray) -> np.ndarray:
    few, place = np.unique(s, return_inverse=True)
    return np.array([math.lgamma(k) for k in few])[place].reshape(s.shape)


def gamma_p(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(s, x), elementwise: a series below s + 1, a continued fraction above."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.zeros(s.shape)
    with np.errstate(all="ignore"):
        front = np.exp(s * np.log(x) - x - _log_gamma(s))
        low = (x > 0) & (x < s + 1)
        if low.any():
            a, b = s[low], x[low]
            term = total = 1 / a
            k = a
            for _ in range(10_000):
                k = k + 1
                term = term * b / k
                total = total + term
                if (np.abs(term) <= 1e-16 * np.abs(total)).all():
                    break
            out[low] = total * front[low]
        high = x >= s + 1
        if high.any():
            a, b = s[high], x[high]
            bottom = b + 1 - a
            c, d = np.full(a.shape, 1e300), 1 / bottom
            h = d
            for k in range(1, 10_000):
                step = -k * (k - a)
                bottom = bottom + 2
                d = step * d + bottom
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = bottom + step / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
                if (np.abs(d * c - 1) <= 1e-15).all():
                    break
            out[high] = 1 - front[high] * h
    out[np.isinf(x)] = 1.0
    return np.clip(out, 0.0, 1.0)


def _gamma_start(a: np.ndarray, p: np.ndarray, log_norm: np.ndarray) -> np.ndarray:
    """A first guess of the inverse: Wilson and Hilferty's cube, or the leading term of the series where that fails."""
    tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    # Hastings' rational approximation of the normal quantile.
    z = tail - (2.515517 + tail * (0.802853 + tail * 0.010328)) / (1 + tail * (1.432788 + tail * (0.189269 + tail * 0.001308)))
    cube = 1 - 1 / (9 * a) + np.where(p < 0.5, -z, z) / (3 * np.sqrt(a))
    lead = np.exp((np.log(p) + log_norm + np.log(a)) / a)
    return np.where((cube > 0.3) & (a > 0.3), a * np.maximum(cube, 0.0) ** 3, lead)


def gamma_p_inverse(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x with P(s, x) = p, elementwise: a bracket by doubling, then guarded Newton steps; p = 1 gives infinity."""
    s, p = np.broadcast_arrays(np.asarray(s, float), np.asarray(p, float))
    out = np.where(p >= 1, np.inf, 0.0)
    todo = (p > 0) & (p < 1)
    if not todo.any():
        return out
    a, q = s[todo], p[todo]
    low, high = np.zeros(a.shape), np.maximum(a, 1.0)
    while (short := gamma_p(a, high) < q).any():
        low = np.where(short, high, low)
        high = np.where(short, 2 * high, high)
    log_norm = _log_gamma(a)
    x = _gamma_start(a, q, log_norm)
    x = np.where((x > low) & (x < high), x, (low + high) / 2)
    live = np.arange(len(a))
    for _ in range(200):
        b, y = a[live], x[live]
        with np.errstate(all="ignore"):
            gap = gamma_p(b, y) - q[live]
            low[live], high[live] = np.where(gap < 0, y, low[live]), np.where(gap < 0, high[live], y)
            new = y - gap / np.exp((b - 1) * np.log(y) - y - log_norm[live])
        inside = (new > low[live]) & (new < high[live])
        new = np.where(inside, new, (low[live] + high[live]) / 2)
        x[live] = new
        live = live[np.abs(new - y) > 1e-14 * np.abs(new)]
        if not len(live):
            break
    out[todo] = x
    return out


@pandas_udf(DoubleType())
def gamma_p_column(s: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(gamma_p(s.to_numpy(float), x.to_numpy(float)))


@pandas_udf(DoubleType())
def gamma_p_inverse_column(s: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(gamma_p_inverse(s.to_numpy(float), p.to_numpy(float)))
