"""Small numeric helpers for reduced data: tails of distributions and batches of tiny linear systems."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float) -> float | None:
    """P(|T| >= |t|) for Student's distribution with df degrees of freedom."""
    if t is None or t != t or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def signed_rank_p(w_plus: float | None, n: int, ties: float = 0.0, alternative: str = "two-sided", exact: bool | None = None) -> float | None:
    """The p-value of Wilcoxon's signed-rank statistic over n differences, none of them 0.

    Exact up to 50 differences without ties, else the normal approximation with variance corrected by
    ties = sum of t^3 - t over groups of t equal ones.
    """
    if w_plus is None or n < 1:
        return None
    total = n * (n + 1) / 2
    if exact if exact is not None else n <= 50 and ties == 0:
        ways = np.zeros(int(total) + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        ways /= 2.0**n
        upper, lower = ways[int(np.ceil(w_plus)) :].sum(), ways[: int(np.floor(w_plus)) + 1].sum()
        return float(upper if alternative == "greater" else min(1.0, 2 * min(upper, lower)))
    sd = sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    if sd == 0:
        return None
    z = (w_plus - total / 2) / sd
    return normal_tail(z) if alternative == "greater" else min(1.0, 2 * normal_tail(abs(z)))


def ridge(n: float, sums: np.ndarray, products: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients (intercept first) from n, the sums of (x..., y) and their cross products.

    Features are standardised with these very sums, so that nothing outside them enters; constant ones get 0.
    """
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    used = sd > 1e-12 * np.maximum(1, np.abs(mean[:-1]))
    out = np.zeros(len(mean))
    if used.any():
        scale = sd[used]
        a = cov[:-1, :-1][np.ix_(used, used)] / np.outer(scale, scale)
        b = cov[:-1, -1][used] / scale
        out[1:][used] = np.linalg.lstsq(a + penalty * np.eye(len(b)), b, rcond=None)[0] / scale
    out[0] = mean[-1] - out[1:] @ mean[:-1]
    return out
