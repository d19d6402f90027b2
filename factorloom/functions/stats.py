"""Small numeric functions: inverse normal, Student's t, polygammas, and false discovery rates as a window."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_NORMAL = NormalDist()
#: Wichura's algorithm AS 241 (1988): numerator and denominator near the middle, in the tails and far out, highest power first.
_AS241 = (
    (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
    (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0),
    (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
    (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0),
    (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
    (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0),
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: str | Column) -> Column:
    """The standard normal quantile; null where p is not between 0 and 1."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    middle, tail = F.lit(0.180625) - q * q, F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    ratio = lambda x, k: _horner(x, _AS241[k]) / _horner(x, _AS241[k + 1])
    outer = F.when(tail <= 5, ratio(tail - 1.6, 2)).otherwise(ratio(tail - 5.0, 4))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(middle, 0)).otherwise(F.when(q < 0, -outer).otherwise(outer)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method on whole arrays."""
    away = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + num * d), away(1 + num / c)
            out = out * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return out


def _each(f, values: np.ndarray) -> np.ndarray:
    """f of every distinct value, once."""
    distinct, inverse = np.unique(values, return_inverse=True)
    return np.array([f(v) for v in distinct.tolist()], float)[inverse]


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(_each(math.lgamma, a + b) - _each(math.lgamma, a) - _each(math.lgamma, b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    part = front * _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, y, 1 - y)) / np.where(low, a, b)
    return np.where(inside, np.where(low, part, 1 - part), (x >= 1).astype(float))


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t; infinite degrees of freedom are the normal distribution. NaN without degrees of freedom."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    shape, t, df = t.shape, t.ravel(), df.ravel()
    normal, none = np.isinf(df), np.isnan(t) | ~(df > 0)
    n = np.where(normal | none, 1.0, df)
    tail = 0.5 * incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + t * t))
    out = np.where(t > 0, 1 - tail, tail)
    if normal.any():
        out[normal] = _each(_NORMAL.cdf, t[normal])
    out[none] = np.nan
    return out.reshape(shape)


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def inverse_trigamma(y: float) -> float:
    """By Newton's method on 1 / trigamma, as in Smyth (2004)."""
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(60):
        tri = trigamma(x)
        tetra = (trigamma(x * (1 + 1e-6)) - trigamma(x * (1 - 1e-6))) / (2e-6 * x)
        step = tri * (1 - tri / y) / tetra
        x += step
        if -step / x < 1e-10:
            break
    return x


def fit_variance_prior(s2: np.ndarray, df: float) -> tuple[float, float]:
    """Prior degrees of freedom and variance of scaled-F distributed variances (moments of log s2)."""
    s2 = np.maximum(s2, 1e-300)
    e = np.log(s2) - digamma(df / 2) + math.log(df / 2)
    mean = float(e.mean())
    rest = float(((e - mean) ** 2).sum() / max(1, len(e) - 1)) - trigamma(df / 2)
    if rest <= 0:
        return math.inf, math.exp(mean)
    d0 = 2 * inverse_trigamma(rest)
    return d0, math.exp(mean + digamma(d0 / 2) - math.log(d0 / 2))


def false_discovery(df: DataFrame, p: str, out: str, by: list[str], ties: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p within groups: the running minimum of p * n / rank from the largest p on."""
    group = W.partitionBy(*by)
    order = [F.col(p).desc(), *[F.col(c).desc() for c in ties]]
    ranked = df.withColumn("_n", F.count(p).over(group)).withColumn("_r", F.row_number().over(group.orderBy(*order)))
    value = F.col(p) * F.col("_n") / (F.col("_n") - F.col("_r") + 1)
    running = F.min(value).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn(out, F.least(F.lit(1.0), running)).drop("_n", "_r")


def average_rank(value: Column, group: list[Column]) -> Column:
    """Ranks from 1, ties averaged."""
    w = W.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*group, value)) - 1) / 2.0
