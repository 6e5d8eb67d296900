"""P-values on the driver, in NumPy and the standard library."""

from __future__ import annotations

import math

import numpy as np


def ks_p_value(d: float | None, n: int, m: int) -> float:
    """Two-sided p of the two-sample KS statistic.

    Exact by counting lattice paths up to n m = 10**7; beyond, the Kolmogorov series with the usual small-sample
    correction, which is within 1e-3.
    """
    if d is None or n == 0 or m == 0:
        return 1.0
    if n * m <= 10**7:
        return _exact(d, n, m)
    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def _exact(d: float, n: int, m: int) -> float:
    """1 less the share of paths from (0, 0) to (n, m) that stay within the distance."""
    if m > n:
        n, m = m, n
    limit = round(d * n * m)
    # row by row over i, the share of all paths to (i, j) that have stayed strictly inside
    j = np.arange(m + 1)
    stay = (np.abs(0 * m - j * n) < limit).astype(float)
    stay = np.cumprod(stay)
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < limit
        new = np.zeros(m + 1)
        last = 0.0
        weight = j / (i + j)
        for k in range(m + 1):
            last = (stay[k] * (1 - weight[k]) + (last * weight[k] if k else 0.0)) if inside[k] else 0.0
            new[k] = last
        stay = new
    return float(min(1.0, max(0.0, 1.0 - stay[m])))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b, c, tiny = x + 1 - a, 1e300, 1e-300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, h * math.exp(log_front))


def chi2_p_value(statistic: float | None, dof: int) -> float:
    if statistic is None or dof <= 0:
        return 1.0
    return math.erfc(math.sqrt(statistic / 2)) if dof == 1 else gamma_q(dof / 2, statistic / 2)
