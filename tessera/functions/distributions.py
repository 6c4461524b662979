"""Discrete and continuous distributions in numpy, with column wrappers.

A discrete distribution is an array p(x), x = 0, 1, ..., cut where what is left is below a small epsilon.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-10
LEAST_P = 1e-20


# -- continuous --------------------------------------------------------------------------------------------------------


def gamma_pdf(x: float, shape: float, rate: float) -> float:
    return 0.0 if x < 0 else math.exp(shape * math.log(rate) + (shape - 1) * math.log(x) - rate * x - math.lgamma(shape)) if x > 0 else (rate if shape == 1 else 0.0)


def gamma_tails(a: float, x: float) -> tuple[float, float]:
    """Lower and upper regularised incomplete gamma functions, each to full relative precision where it is small."""
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        low = min(1.0, total * front)
        return low, 1 - low
    tiny = 1e-300  # continued fraction (modified Lentz)
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    up = min(1.0, h * front)
    return 1 - up, up


def gamma_cdf(x: float, shape: float, rate: float, lower: bool = True) -> float:
    return gamma_tails(shape, rate * x)[0 if lower else 1]


def chisq_pdf(x: float, k: float) -> float:
    return gamma_pdf(x, k / 2, 0.5)


def chisq_cdf(x: float, k: float, lower: bool = True) -> float:
    return gamma_tails(k / 2, x / 2)[0 if lower else 1]


def half_chisq_cdf(x: float, k: float, lower: bool = True) -> float:
    """Even mixture of a point at 0 and the chi-square."""
    upper = 1.0 if x <= 0 else 0.5 * chisq_cdf(x, k, lower=False)
    return 1 - upper if lower else upper


def _solve(f: Callable[[float], float], low: float, high: float) -> float:
    """Root of an increasing function by bisection to machine precision."""
    while f(high) < 0:
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def chisq_quantile(p: float, k: float, lower: bool = True) -> float:
    if lower:
        return 0.0 if p <= 0 else _solve(lambda x: chisq_cdf(x, k) - p, 0.0, max(1.0, 2 * k))
    return _solve(lambda x: p - chisq_cdf(x, k, lower=False), 0.0, max(1.0, 2 * k))


def normal_cdf(x: float, upper: bool = False) -> float:
    return 0.5 * math.erfc((x if upper else -x) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function."""
    if not 0 < p < 1:
        raise ValueError("p must lie in (0, 1)")
    return -_solve(lambda x: normal_cdf(x) - (1 - p), 0.0, 40.0) if p < 0.5 else _solve(lambda x: normal_cdf(x) - p, 0.0, 40.0)


def normal_interval(mean: float, sd: float, level: float) -> tuple[float, float]:
    z = normal_quantile(0.5 + level / 2)
    return mean - z * sd, mean + z * sd


def bivariate_normal_pdf(x: float, y: float, mx: float, my: float, sx: float, sy: float, rho: float) -> float:
    u, v = (x - mx) / sx, (y - my) / sy
    return math.exp(-(u * u - 2 * rho * u * v + v * v) / (2 * (1 - rho**2))) / (2 * math.pi * sx * sy * math.sqrt(1 - rho**2))


def beta_pdf(x: float, a: float, b: float) -> float:
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log(1 - x))


def discrete_gamma(shape: float, k: int, median: bool = False) -> np.ndarray:
    """Rates of k equally probable classes of a gamma distribution with mean 1: class means, or medians scaled to mean 1."""
    if median:
        r = np.array([chisq_quantile((2 * i + 1) / (2 * k), 2 * shape) / (2 * shape) for i in range(k)])
        return r / r.mean()
    cuts = [chisq_quantile(i / k, 2 * shape) / (2 * shape) for i in range(1, k)]
    shares = [0.0, *[gamma_tails(shape + 1, c * shape)[0] for c in cuts], 1.0]
    return k * np.diff(shares)


# -- discrete ----------------------------------------------------------------------------------------------------------


def normalise(p: np.ndarray) -> np.ndarray:
    return np.asarray(p, float) / np.sum(p)


def trimmed(p: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Without the upper end whose mass is below epsilon."""
    tail = np.cumsum(p[::-1])[::-1]
    n = max(1, int((tail > epsilon).sum()))
    return p[:n]


def poisson(mean: float, epsilon: float = EPSILON) -> np.ndarray:
    n = int(mean + 12 * math.sqrt(mean) + 30)
    x = np.arange(n)
    logs = x * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in x]) if mean > 0 else np.where(x == 0, 0.0, -np.inf)
    return trimmed(np.exp(logs), epsilon)


def poisson_cdf(x: int, mean: float, upper: bool = False) -> float:
    """P(X <= x), or P(X > x)."""
    low, up = gamma_tails(x + 1, mean)
    return low if upper else up


def mean_var(p: np.ndarray) -> tuple[float, float]:
    x = np.arange(len(p))
    m = float((x * p).sum())
    return m, float((x * x * p).sum() - m * m)


def cdf(p: np.ndarray, upper: bool = False) -> np.ndarray:
    """P(X <= x), or P(X >= x)."""
    return np.cumsum(p[::-1])[::-1] if upper else np.cumsum(p)


def p_value(p: np.ndarray, x: float, side: str = "lower") -> float:
    """P(X <= x), P(X >= x), or twice the smaller, at most 1."""
    low = float(p[: int(math.floor(x)) + 1].sum()) if x >= 0 else 0.0
    high = float(p[max(0, int(math.ceil(x))) :].sum())
    return {"lower": low, "upper": high, "both": min(1.0, 2 * min(low, high))}[side]


def quantile(p: np.ndarray, q: float) -> int:
    """Least x with P(X <= x) >= q."""
    return int(min(np.searchsorted(np.cumsum(p), q - 1e-15), len(p) - 1))


def percentiles(p: np.ndarray) -> np.ndarray:
    return np.array([quantile(p, i / 100) for i in range(101)])


def interval(p: np.ndarray, level: float = 0.95) -> tuple[int, int]:
    tail = (1 - level) / 2
    return quantile(p, tail), quantile(p, 1 - tail)


def convolve(p: np.ndarray, n: int, epsilon: float = EPSILON) -> np.ndarray:
    """Distribution of the sum of n independent draws, by doubling."""
    out, power = np.ones(1), np.asarray(p, float)
    while n:
        if n & 1:
            out = trimmed(np.convolve(out, power), epsilon)
        n >>= 1
        if n:
            power = trimmed(np.convolve(power, power), epsilon)
    return normalise(out)


def convolve_many(ps: Sequence[np.ndarray], counts: Sequence[int], epsilon: float = EPSILON) -> np.ndarray:
    out = np.ones(1)
    for p, n in zip(ps, counts):
        out = trimmed(np.convolve(out, convolve(p, int(n), epsilon)), epsilon)
    return normalise(out)


def convolve2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Joint distributions of sums, by the product of their transforms."""
    shape = [a + b - 1 for a, b in zip(p.shape, q.shape)]
    return np.clip(np.fft.irfft2(np.fft.rfft2(p, shape) * np.fft.rfft2(q, shape), shape), 0, None)


def marginals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p.sum(1), p.sum(0)


def total_of(p: np.ndarray) -> np.ndarray:
    """Distribution of x + y."""
    out = np.zeros(sum(p.shape) - 1)
    for x in range(p.shape[0]):
        out[x : x + p.shape[1]] += p[x]
    return out


def x_given_total(p: np.ndarray, total: int) -> np.ndarray:
    x = np.arange(min(total, p.shape[0] - 1) + 1)
    y = total - x
    out = np.where(y < p.shape[1], p[x, np.minimum(y, p.shape[1] - 1)], 0.0)
    return normalise(out)


def joint_moments(p: np.ndarray) -> dict[str, float]:
    x, y = np.arange(p.shape[0]), np.arange(p.shape[1])
    mx, my = float(x @ p.sum(1)), float(y @ p.sum(0))
    return {"mean_x": mx, "mean_y": my, "var_x": float(x**2 @ p.sum(1) - mx**2), "var_y": float(y**2 @ p.sum(0) - my**2), "cov": float(x @ p @ y - mx * my)}


def summary(values: np.ndarray) -> dict[str, float]:
    """Mean, sample deviation, median, ends and 95 and 90 percent bounds (quantiles interpolated on n - 1)."""
    v = np.asarray(values, float)
    q = np.quantile(v, [0.025, 0.05, 0.5, 0.95, 0.975])
    return {"mean": float(v.mean()), "stdev": float(v.std(ddof=1)) if len(v) > 1 else 0.0, "median": float(q[2]), "min": float(v.min()), "max": float(v.max()), "low95": float(q[0]), "high95": float(q[4]), "low90": float(q[1]), "high90": float(q[3])}


def log10_p(p: float, sign: float = 1.0) -> float:
    return math.copysign(-math.log10(max(p, LEAST_P)), sign)


def simplex_grid(dim: int, parts: int) -> np.ndarray:
    """All probability vectors whose entries are multiples of 1 / parts."""
    if dim == 1:
        return np.array([[1.0]]) if parts else np.array([[0.0]])
    out = []

    def fill(left: int, places: int, head: list[int]) -> None:
        if places == 1:
            out.append([*head, left])
            return
        for i in range(left + 1):
            fill(left - i, places - 1, [*head, i])

    fill(parts, dim, [])
    return np.array(out, float) / parts


# -- columns -----------------------------------------------------------------------------------------------------------


def vectorised(function: Callable[..., float], *parameters: float) -> Callable[[Column], Column]:
    """A scalar function of one value as a column function (Arrow batches)."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if pd.isna(x) else function(float(x), *parameters))

    return run


def pmf_table(rows: DataFrame, value: str) -> DataFrame:
    """x and p of an integer column."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.broadcast(counts.agg(F.sum("cnt").alias("_t")).withColumn("_k", F.lit(1)))  # one row
    return counts.withColumn("_k", F.lit(1)).join(total, "_k").select("x", "cnt", (F.col("cnt") / F.col("_t")).alias("p"))


def to_array(pmf: DataFrame) -> np.ndarray:
    """p(x) from a small table (x, p) of a distribution."""
    found = [(r["x"], r["p"]) for r in pmf.select("x", "p").collect()]
    out = np.zeros(max((x for x, _ in found), default=0) + 1)
    for x, p in found:
        out[x] += p
    return out
