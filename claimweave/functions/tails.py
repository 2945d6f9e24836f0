"""Normal and chi-square tail probabilities for a handful of test statistics."""

from __future__ import annotations

import math

Z95 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable, by the finite sums for whole degrees of freedom."""
    if df < 1:
        raise ValueError("degrees of freedom must be positive")
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = math.exp(-half), math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(total, 1.0)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return min(total, 1.0)
