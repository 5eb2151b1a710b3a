"""Distribution functions for a few numbers on the driver."""

from __future__ import annotations

import math


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_cdf(t: float, df: float) -> float:
    tail = t_two_sided(t, df) / 2
    return 1 - tail if t > 0 else tail


def f_upper(f: float, d1: float, d2: float) -> float:
    if not math.isfinite(f):
        return 0.0
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _inverse(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2
    while cdf(low) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_ppf(p: float, df: float) -> float:
    return _inverse(lambda t: t_cdf(t, df), p, -2.0, 2.0)


def norm_ppf(p: float) -> float:
    return _inverse(norm_cdf, p, -2.0, 2.0)
