"""Tail probabilities, applied to small result tables after the aggregation is done.

Spark has no ``erf``/``lgamma``, so these are numpy over whole arrays behind pandas UDFs. Each takes
columns that already hold one value per stratum.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def lgamma(x):
    """Logarithm of the gamma function of positive numbers, whole arrays at once: shifted up, then by Stirling's series."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        low = np.where(x < 16, x, 1.0)
        steps = np.ones_like(low)
        for i in range(16):
            steps = steps * (low + i)
        y = np.where(x < 16, x + 16, x)
        z = 1 / (y * y)
        rest = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
        out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + rest
        return np.where(x < 16, out - np.log(steps), out)


def _scaled_erfc(t):
    """``erfc(x) exp(x^2) / t`` at ``x = 2 / t - 2``, for the interpolation below."""
    x = 2 / t - 2
    near = np.array([math.erfc(v) * math.exp(v * v) if v < 12 else 0.0 for v in x.tolist()])
    y = 1 / (2 * np.maximum(x, 1.0) ** 2)
    term, far = np.ones_like(x), np.ones_like(x)
    for k in range(1, 12):
        term = term * -(2 * k - 1) * y
        far = far + np.where(x >= 12, term, 0.0)
    return np.where(x < 12, near, far / (np.maximum(x, 1.0) * math.sqrt(math.pi))) / t


# by rule, from the library's scalar function at the nodes of an interpolation on 0 < t <= 1
_ERFC = np.polynomial.chebyshev.chebinterpolate(lambda u: _scaled_erfc((u + 1) / 2), 48)


def erfc(x):
    """Complementary error function of whole arrays."""
    x = np.asarray(x, float)
    a = np.abs(x)
    t = 2 / (2 + a)
    with np.errstate(all="ignore"):
        out = t * np.polynomial.chebyshev.chebval(2 * t - 1, _ERFC) * np.exp(-a * a)
    return np.where(x < 0, 2 - out, out)


def normal_sf(x):
    return 0.5 * erfc(np.asarray(x, dtype=float) / math.sqrt(2.0))


def gamma_sf(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - lgamma(np.where(a > 0, a, 1.0)))
        low = ok & (x > 0) & (x < a + 1)
        if low.any():
            aa, xx = a[low], x[low]
            term = 1.0 / aa
            total = term.copy()
            for k in range(1, 2000):
                term = term * xx / (aa + k)
                total += term
                if np.all(np.abs(term) <= np.abs(total) * 1e-16):
                    break
            out[low] = 1.0 - total * front[low]
        high = ok & (x >= a + 1) & np.isfinite(x)
        if high.any():
            aa, xx = a[high], x[high]
            b = xx + 1 - aa
            c = np.full(aa.shape, 1e300)
            d = 1.0 / b
            h = d.copy()
            for k in range(1, 2000):
                an = -k * (k - aa)
                b = b + 2
                d = 1.0 / _away(an * d + b)
                c = _away(b + an / c)
                step = d * c
                h = h * step
                if np.all(np.abs(step - 1) < 1e-15):
                    break
            out[high] = front[high] * h
    out[ok & np.isposinf(x)] = 0.0
    return out


def _away(v):
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def chi2_sf(x, df):
    return gamma_sf(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def beta_cdf(a, b, x):
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (v.astype(float).copy() for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        safe = np.clip(x, 1e-300, 1.0)
        front = np.exp(
            lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(safe) + b * np.log1p(-np.clip(x, 0, 1 - 1e-16))
        )
        c = np.ones_like(x)
        d = 1.0 / _away(1 - (a + b) * x / (a + 1))
        h = d.copy()
        settled = np.zeros(x.shape, bool)  # once is enough: steps of one may go on by a rounding error
        for m in range(1, 500):
            up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 / _away(1 + up * d)
            c = _away(1 + up / c)
            h = h * d * c
            dn = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 / _away(1 + dn * d)
            c = _away(1 + dn / c)
            step = d * c
            h = h * step
            settled |= (np.abs(step - 1) < 1e-15) | np.isnan(step)
            if settled.all():
                break
        cdf = np.where(x <= 0, 0.0, front * h / a)
    return np.where(flip, 1 - cdf, cdf)


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    v = np.where(df > 0, df, 1.0)
    with np.errstate(all="ignore"):
        out = beta_cdf(v / 2.0, np.full(v.shape, 0.5), v / (v + t * t))
    return np.where(np.isfinite(t) & (df > 0), out, np.where(np.isinf(t), 0.0, np.nan))


def f_sf(x, d1, d2):
    x, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, d1, d2)))
    with np.errstate(all="ignore"):
        tail = np.where(x > 0, beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(x, 0))), 1.0)
    return np.where(np.isnan(x) | np.isnan(d1) | np.isnan(d2), np.nan, tail)


@lru_cache(maxsize=4)
def _legendre(n):
    return np.polynomial.legendre.leggauss(n)


def _range_cdf(w, k):
    """CDF of the range of ``k`` standard normals at each ``w``."""
    nodes, weights = _legendre(96)
    z = nodes * 8.0
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = 1 - normal_sf(z[None, :] + w[:, None])
    inner = (upper - (1 - normal_sf(z))[None, :]) ** (k - 1)
    return np.clip(k * 8.0 * np.sum(weights * phi * inner, axis=1), 0.0, 1.0)


def studentized_range_sf(q, k: int, df: float):
    """Upper tail of the studentized range at every ``q``: integrated over the scaled chi density, all at once."""
    q = np.atleast_1d(np.asarray(q, float))
    out = np.where(q <= 0, 1.0, np.nan)
    some = np.flatnonzero(q > 0)
    if not (df > 0 and k >= 2) or not len(some):
        return np.where(q <= 0, out, np.nan)
    if df > 1e6:
        out[some] = 1 - _range_cdf(q[some], k)
        return out
    nodes, weights = _legendre(96)
    spread = 1 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - 9 * spread), 1 + 10 * spread
    s = (hi - lo) / 2 * nodes + (hi + lo) / 2
    logd = (
        (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
        + (df - 1) * np.log(s) - df * s * s / 2
    )
    density = weights * np.exp(logd) * (hi - lo) / 2
    for at in range(0, len(some), 64):  # a table of 64 x 96 x 96
        part = some[at : at + 64]
        cdf = _range_cdf((q[part, None] * s).ravel(), k).reshape(len(part), -1) @ density
        out[part] = np.clip(1 - cdf, 0.0, 1.0)
    return out


@lru_cache(maxsize=512)
def _rank_sum_cdf(n: int, m: int) -> np.ndarray:
    """CDF of W for two untied samples: coefficients of the Gaussian binomial, by counting."""
    ways = np.zeros((n + 1, n * (n + m) + 1))
    ways[0, 0] = 1.0
    for r in range(1, n + m + 1):
        for j in range(min(n, r), 0, -1):
            ways[j, r:] += ways[j - 1, : ways.shape[1] - r]
    base = n * (n + 1) // 2
    probs = ways[n, base : base + n * m + 1]
    return np.cumsum(probs) / probs.sum()


def rank_sum_exact(w: float, n: int, m: int) -> float:
    cdf = _rank_sum_cdf(int(n), int(m))
    k = int(round(w))
    tail = 1 - (cdf[k - 1] if k > 0 else 0.0) if w > n * m / 2 else cdf[k]
    return float(min(1.0, 2 * tail))


@lru_cache(maxsize=16)
def _spearman_counts(n: int) -> np.ndarray:
    """How many permutations of 1..n give each value of sum((i - perm(i))^2)."""
    width = n * (n * n - 1) // 3 + 1
    table = {0: np.zeros(width)}
    table[0][0] = 1.0
    for i in range(n):
        following: dict[int, np.ndarray] = {}
        for used, dist in table.items():
            for j in range(n):
                if not used & (1 << j):
                    step = (i - j) ** 2
                    target = following.setdefault(used | (1 << j), np.zeros(width))
                    target[step:] += dist[: width - step]
        table = following
    return table[(1 << n) - 1]


def spearman_p(rho: float, n: int, ties: bool) -> float:
    """Two-sided p: exact up to n = 9, Edgeworth series to n = 1290, t beyond or with ties."""
    if n < 3 or rho != rho:
        return float("nan")
    if ties or n > 1290:
        if abs(rho) >= 1:
            return 0.0
        return float(t_two_sided(rho / math.sqrt((1 - rho * rho) / (n - 2)), n - 2))
    mid = n * (n * n - 1) / 6.0
    s = round((1 - rho) * mid)
    if n <= 9:
        counts = _spearman_counts(n)
        total = counts.sum()
        tail = counts[int(s) :].sum() / total if s > mid else counts[: int(s) + 1].sum() / total
        return float(min(1.0, 2 * tail))
    # Edgeworth coefficients of the published algorithm (fixed values)
    c = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)
    lower = s <= mid
    stat = s + 2 if lower else s - 1
    b = 1.0 / n
    x = (6.0 * (stat - 1) * b / (n * n - 1.0) - 1.0) * math.sqrt(1 / b - 1)
    y = x * x
    u = x * b * (c[0] + b * (c[1] + c[2] * b) + y * (-c[3] + b * (c[4] + c[5] * b) - y * b * (
        c[6] + c[7] * b - y * (c[8] - c[9] * b + y * b * (c[10] - c[11] * y)))))
    upper = min(1.0, max(0.0, u / math.exp(y / 2) + float(normal_sf(x))))
    return float(min(1.0, 2 * (upper if not lower else 1 - upper)))


def _udf(fn):
    return F.pandas_udf(fn, "double")


def _arr(s: pd.Series) -> np.ndarray:
    return s.astype("float64").to_numpy()


def p_chi2(x: Column, df: Column) -> Column:
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(_arr(a), _arr(b)))

    return _null_nan(_udf(f)(x.cast("double"), df.cast("double")))


def p_normal_two_sided(z: Column) -> Column:
    def f(a: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(1.0, 2 * normal_sf(np.abs(_arr(a)))))

    return _null_nan(_udf(f)(z.cast("double")))


def p_t(t: Column, df: Column) -> Column:
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(_arr(a), _arr(b)))

    return _null_nan(_udf(f)(t.cast("double"), df.cast("double")))


def p_f(x: Column, d1: Column, d2: Column) -> Column:
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(f_sf(_arr(a), _arr(b), _arr(c)))

    return _null_nan(_udf(f)(x.cast("double"), d1.cast("double"), d2.cast("double")))


def p_studentized_range(q: Column, k: Column, df: Column) -> Column:
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        cells = pd.DataFrame({"q": _arr(a), "k": _arr(b), "df": _arr(c)}).dropna()
        for (k, df), part in cells.groupby(["k", "df"])["q"]:
            out[part.index] = studentized_range_sf(part.to_numpy(), int(k), float(df))
        return pd.Series(out)

    return _null_nan(_udf(f)(q.cast("double"), k.cast("double"), df.cast("double")))


def p_rank_sum_exact(w: Column, n: Column, m: Column) -> Column:
    """Exact two-sided p; NULL inputs (strata that take the normal path) give NULL."""

    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(
            [rank_sum_exact(*v) if all(x == x for x in v) else np.nan for v in zip(_arr(a), _arr(b), _arr(c))],
            dtype=float,
        )

    return _null_nan(_udf(f)(w.cast("double"), n.cast("double"), m.cast("double")))


def p_spearman(rho: Column, n: Column, ties: Column) -> Column:
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        r, k, tied = _arr(a), _arr(b), c.to_numpy(bool) | (_arr(b) > 1290)
        with np.errstate(all="ignore"):
            out = t_two_sided(r * np.sqrt((k - 2) / np.maximum(0.0, 1 - r * r)), k - 2)
        out = np.where(np.isnan(r) | (k < 3), np.nan, out)
        for i in np.flatnonzero(~tied & ~np.isnan(r)):
            out[i] = spearman_p(r[i], int(k[i]), False)
        return pd.Series(out)

    return _null_nan(_udf(f)(rho.cast("double"), n.cast("double"), ties))


def _null_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


# Rational approximation of the normal quantile (fixed values): numerators and denominators for
# the central region, the middle tail and the far tail.
PROBIT = {
    "central": (
        (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
         45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
        (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
         21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    ),
    "middle": (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
         1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
         0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
         0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def probit(p: Column) -> Column:
    """Standard normal quantile as a Column, evaluated on the JVM side."""

    def poly(cs, x):
        out = F.lit(cs[-1])
        for c in reversed(cs[:-1]):
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    r1 = F.sqrt(-F.log(F.least(p, 1 - p)))
    (ca, cb), (ma, mb), (fa, fb) = PROBIT["central"], PROBIT["middle"], PROBIT["far"]
    return (
        F.when(F.abs(q) <= 0.425, q * poly(ca, r0) / poly(cb, r0))
        .when(r1 <= 5.0, F.signum(q) * poly(ma, r1 - 1.6) / poly(mb, r1 - 1.6))
        .otherwise(F.signum(q) * poly(fa, r1 - 5.0) / poly(fb, r1 - 5.0))
    )
