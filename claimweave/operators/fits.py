"""Model results: tidy tables, fit summaries and ratio tables built from small coefficient arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from claimweave.functions.tails import Z95, chi2_tail, normal_two_sided


@dataclass
class Fit:
    """Estimates of one model. ``var`` is the model-based, ``robust`` the sandwich covariance."""

    spark: SparkSession
    kind: str
    terms: list[str]
    beta: np.ndarray
    var: np.ndarray
    robust: np.ndarray | None = None
    stats: dict[str, float] = field(default_factory=dict)
    limits: np.ndarray | None = None
    converged: bool = True
    iterations: int = 0
    kept: np.ndarray | None = None  # False for terms that repeat earlier ones; their coefficient is 0 and unknown

    @property
    def dropped(self) -> list[str]:
        """Terms left out because earlier terms determine them (or because they never vary)."""
        return [] if self.kept is None else [t for t, k in zip(self.terms, self.kept) if not k]

    def se(self, kind: str = "auto") -> np.ndarray:
        use_robust = self.robust is not None if kind == "auto" else kind == "robust"
        var = self.robust if use_robust else self.var
        if var is None:
            raise ValueError("this fit has no robust covariance")
        return np.sqrt(np.maximum(np.diag(var), 0.0))

    def tidy(self, se: str = "auto", z: float = Z95) -> DataFrame:
        """One row per term: estimate, standard error, z, p and Wald limits; all null for dropped terms."""
        rows = []
        for term, b, s in zip(self.terms, self.beta, self.se(se)):
            if term in self.dropped:
                rows.append((term, *[None] * 6))
                continue
            stat = float(b / s) if s > 0 else math.nan
            rows.append(
                (term, float(b), float(s), stat, normal_two_sided(stat), float(b - z * s), float(b + z * s))
            )
        schema = "term string, estimate double, std_err double, statistic double, p_value double, lower double, upper double"
        return self.spark.createDataFrame(rows, schema)

    def summary(self) -> DataFrame:
        """Fit-level numbers: deviances, likelihood-ratio, Wald and score tests, counts."""
        rows = [(k, float(v)) for k, v in self.stats.items()]
        rows += [("iterations", float(self.iterations)), ("converged", float(self.converged)), ("dropped", float(len(self.dropped)))]
        return self.spark.createDataFrame(rows, "statistic string, value double")


def ratio_table(
    fit: Fit, se: str = "auto", z: float = Z95, digits: tuple[int, int, int] | None = None, ci: str = "wald"
) -> DataFrame:
    """Odds, hazard or rate ratios: ``exp(b)``, limits and p. ``ci='profile'`` uses stored profile limits.

    ``digits`` rounds the ratio, its limits and the p-value.
    """
    if ci == "profile":
        if fit.limits is None:
            raise ValueError("profile limits were not computed for this fit")
        limits = fit.limits
    elif ci == "wald":
        s = fit.se(se)
        limits = np.stack([fit.beta - z * s, fit.beta + z * s], axis=1)
    else:
        raise ValueError("ci is 'wald' or 'profile'")
    rows = []
    for term, b, s, (lo, hi) in zip(fit.terms, fit.beta, fit.se(se), limits):
        if term in fit.dropped:
            rows.append((term, *[None] * 4))
            continue
        values = [math.exp(b), math.exp(lo), math.exp(hi), normal_two_sided(b / s) if s > 0 else math.nan]
        if digits is not None:
            places = [digits[0], digits[1], digits[1], digits[2]]
            values = [round(v, k) for v, k in zip(values, places)]
        rows.append((term, *[float(v) for v in values]))
    return fit.spark.createDataFrame(rows, "term string, ratio double, lower double, upper double, p_value double")


def independent(info: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Which terms earlier ones do not determine: Cholesky steps in order on the information scaled to a unit diagonal.

    A term whose remaining pivot is below ``tol`` is dropped, as is one without information, and the steps go on
    without it; so of u and 2u the first stays.
    """
    scale = np.sqrt(np.maximum(np.diag(info), 0.0))
    left = np.where(np.outer(scale, scale) > 0, info / np.maximum(np.outer(scale, scale), 1e-300), 0.0)
    kept = np.zeros(len(info), dtype=bool)
    for j in range(len(info)):
        if left[j, j] > tol:
            kept[j] = True
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def inverse(info: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Inverse over the kept terms, zero elsewhere."""
    out = np.zeros_like(info, dtype=float)
    if kept.any():
        out[np.ix_(kept, kept)] = np.linalg.pinv(info[np.ix_(kept, kept)], hermitian=True)
    return out


def wald(beta: np.ndarray, var: np.ndarray) -> float:
    return float(beta @ np.linalg.pinv(var) @ beta)


def likelihood_tests(
    beta: np.ndarray, info: np.ndarray, score0: np.ndarray, info0: np.ndarray, ll0: float, ll: float, kept: np.ndarray
) -> dict[str, float]:
    """Likelihood-ratio, Wald and score statistics with their p-values over the kept terms."""
    p = max(int(kept.sum()), 1)
    lr = 2.0 * (ll - ll0)
    w = float(beta @ info @ beta)
    score = float(score0 @ inverse(info0, kept) @ score0)
    return {
        "loglik_null": ll0,
        "loglik": ll,
        "lr_chisq": lr,
        "lr_p": chi2_tail(lr, p),
        "wald_chisq": w,
        "wald_p": chi2_tail(w, p),
        "score_chisq": score,
        "score_p": chi2_tail(score, p),
    }


def upper_triangle(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(p) for k in range(j, p)]


def symmetric(row, prefix: str, p: int) -> np.ndarray:
    """p x p matrix from row fields ``{prefix}{j}_{k}`` with j <= k."""
    out = np.zeros((p, p))
    for j, k in upper_triangle(p):
        out[j, k] = out[k, j] = float(row[f"{prefix}{j}_{k}"] or 0.0)
    return out


def vector(row, prefix: str, p: int) -> np.ndarray:
    return np.array([float(row[f"{prefix}{j}"] or 0.0) for j in range(p)])


def linear(beta: Sequence[float], names: Sequence[str]) -> str:
    """SQL text of a linear predictor with full-precision coefficients, as a plain sum that is compiled whole."""
    return "(" + (" + ".join(f"{name} * {float(b)!r}D" for b, name in zip(beta, names)) or "0D") + ")"
