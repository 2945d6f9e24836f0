"""Logistic regression with Wald and profile-likelihood limits, and Poisson GEE."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from claimweave.functions.tails import Z95
from claimweave.operators.fits import Fit, independent, inverse, linear, symmetric, upper_triangle, vector

INTERCEPT = "(Intercept)"


def _patterns(df: DataFrame, y: str, xs: Sequence[str], weight: str | None) -> DataFrame:
    """Sum complete rows to distinct (outcome, covariates) patterns with their total weight."""
    names = [f"x{j + 1}" for j in range(len(xs))]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keep = [y, *xs, *([weight] if weight else [])]
    rows = df.dropna(subset=keep).select(
        F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names)], w.alias("w")
    )
    return rows.groupBy("y", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def _binomial_pass(patterns: DataFrame, candidates: np.ndarray):
    """Log-likelihood, gradient and information at several coefficient vectors in one query."""
    m, p = candidates.shape
    names = ["x0", *[f"x{j}" for j in range(1, p)]]
    eta = F.array(*[F.expr(linear(b, names)) for b in candidates])
    rows = patterns.withColumn("x0", F.lit(1.0)).select("*", F.posexplode(eta).alias("m", "eta"))
    rows = rows.withColumn("mu", F.expr("1 / (1 + exp(-eta))"))
    aggs = [F.expr("sum(w * (y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta)))))").alias("ll")]
    aggs += [F.expr(f"sum(w * (y - mu) * x{j})").alias(f"u{j}") for j in range(p)]
    aggs += [F.expr(f"sum(w * mu * (1 - mu) * x{j} * x{k})").alias(f"i{j}_{k}") for j, k in upper_triangle(p)]
    found = {r["m"]: r for r in rows.groupBy("m").agg(*aggs).collect()}
    return [(float(found[i]["ll"]), vector(found[i], "u", p), symmetric(found[i], "i", p)) for i in range(m)]


def _profile_limits(patterns: DataFrame, beta: np.ndarray, ll: float, var: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Profile-likelihood limits of all coefficients, both sides, searched together.

    For each coefficient and side, Newton steps solve "log-likelihood is the maximum minus z2/2, and the
    gradient in all other coefficients is zero"; every step evaluates all open searches in one query.
    """
    p = len(beta)
    target = ll - Z95**2 / 2
    jobs = [(j, side) for j in np.flatnonzero(kept) for side in (-1.0, 1.0)]
    theta = np.array([beta + side * Z95 * var[:, j] / np.sqrt(var[j, j]) for j, side in jobs])
    done = np.zeros(len(jobs), dtype=bool)
    for _ in range(30):
        active = np.flatnonzero(~done)
        if not len(active):
            break
        for i, (value, u, info) in zip(active, _binomial_pass(patterns, theta[active])):
            j = jobs[i][0]
            others = [k for k in np.flatnonzero(kept) if k != j]
            system = np.vstack([u, -info[others]])
            gap = np.concatenate([[target - value], -u[others]])
            delta = np.zeros(p)
            delta[kept] = np.linalg.pinv(system[:, kept]) @ gap
            # Short steps far from the solution: the surface is only nearly quadratic.
            cap = 2.0 * np.sqrt(np.diag(var))
            delta *= min(1.0, float(np.min(cap[kept] / np.maximum(np.abs(delta[kept]), 1e-300))))
            theta[i] = theta[i] + delta
            done[i] = np.max(np.abs(gap)) < 1e-8 * (abs(ll) + 1) and np.max(np.abs(delta)) < 1e-7
    limits = np.full((p, 2), np.nan)
    for i, (j, side) in enumerate(jobs):
        if done[i]:
            limits[j, 0 if side < 0 else 1] = theta[i, j]
    return limits


def logistic(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    weight: str | None = None,
    profile: bool = False,
    max_iter: int = 50,
    tol: float = 1e-10,
) -> Fit:
    """Logistic regression of a 0/1 outcome, fitted on distinct covariate patterns.

    Newton steps with step-halving over one aggregate query each. MLlib's GLM starts a weighted 0/1 row
    at a fitted value near its outcome and diverges on patterns with large weights, so it is not used.
    """
    patterns = _patterns(df, y, xs, weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = patterns.agg(
            F.sum("n").alias("n"), F.sum(F.expr("n * y")).alias("events"), F.sum("w").alias("w"),
            F.sum(F.expr("w * y")).alias("wy"),
            *[(F.max(f"x{j + 1}") - F.min(f"x{j + 1}")).alias(f"r{j}") for j in range(len(xs))],
        ).first()
        if not size["w"] or not 0 < size["wy"] < size["w"]:
            raise ValueError("the outcome does not take both values")
        w, wy = float(size["w"]), float(size["wy"])
        # Coefficients are judged by what they change in the linear predictor, whatever the covariates' units.
        width = np.append(1.0, vector(size, "r", len(xs)))
        null_ll = wy * np.log(wy / w) + (w - wy) * np.log(1 - wy / w)
        beta = np.zeros(len(xs) + 1)
        beta[0] = np.log(wy / (w - wy))
        ((ll, u, info),) = _binomial_pass(patterns, beta[None, :])
        kept = independent(info)
        converged, iteration = False, 0
        for iteration in range(1, max_iter + 1):
            delta, scale = inverse(info, kept) @ u, 1.0
            ((new, new_u, new_info),) = _binomial_pass(patterns, (beta + delta)[None, :])
            while new < ll - 1e-9 * (abs(ll) + 1) and scale > 1e-4:
                scale /= 2
                ((new, new_u, new_info),) = _binomial_pass(patterns, (beta + scale * delta)[None, :])
            beta = beta + scale * delta
            change, moved = abs(new - ll), float(np.max(np.abs(scale * delta) * width))
            ll, u, info = new, new_u, new_info
            if change <= tol * (abs(ll) + 1) and moved < 1e-7 * (1 + float(np.max(np.abs(beta) * width))):
                converged = True
                break
        var = inverse(info, kept)
        stats = {
            "n": float(size["n"]),
            "events": float(size["events"]),
            "null_deviance": -2 * null_ll,
            "deviance": -2 * ll,
            "aic": -2 * ll + 2 * int(kept.sum()),
            "loglik": ll,
        }
        # A coefficient that keeps growing while the likelihood is flat is separation.
        separated = bool(np.any((np.sqrt(np.diag(var)) * width)[1:] > 1e3))
        limits = _profile_limits(patterns, beta, ll, var, kept) if profile else None
        return Fit(
            df.sparkSession, "logistic", [INTERCEPT, *xs], beta, var, stats=stats, limits=limits,
            converged=converged and not separated, iterations=iteration, kept=kept,
        )
    finally:
        patterns.unpersist()


def predict_probability(df: DataFrame, fit: Fit, name: str) -> DataFrame:
    """Add the fitted probability as a plain column expression."""
    names = ["1D", *[f"`{c}`" for c in fit.terms[1:]]]
    return df.withColumn(name, F.expr(f"1 / (1 + exp(-{linear(fit.beta, names)}))"))


def poisson_gee(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    id: str,
    offset: str | None = None,
    corr: str = "exchangeable",
    max_iter: int = 50,
    tol: float = 1e-9,
) -> Fit:
    """Poisson marginal model with a log link and sandwich covariance; clusters are the values of ``id``.

    Under exchangeable correlation a cluster enters the equations only through sums over its rows, so
    rows are reduced to distinct patterns per cluster and no correlation matrix is ever built.
    """
    if corr not in ("exchangeable", "independence"):
        raise ValueError("corr is 'exchangeable' or 'independence'")
    terms = [INTERCEPT, *xs]
    p = len(terms)
    names = [f"x{j}" for j in range(p)]
    pairs = upper_triangle(p)
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    rows = df.dropna(subset=[y, id, *xs, *([offset] if offset else [])]).select(
        F.col(id).alias("_id"),
        F.col(y).cast("double").alias("y"),
        off.alias("_off"),
        F.lit(1.0).alias("x0"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names[1:])],
    )
    patterns = rows.groupBy("_id", "_off", *names).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
    )
    # Patterns stay spread as they are; each pass sums clusters in two steps, however wide one is.
    patterns = patterns.persist(StorageLevel.MEMORY_AND_DISK)

    def one_pass(beta: np.ndarray, alpha: float):
        at = patterns.withColumn("mu", F.expr(f"exp({linear(beta, names)} + _off)"))
        at = at.withColumn("rt", F.sqrt("mu"))
        sums = {"n": "n", "e": "(sy - n * mu) / rt", "ee": "(syy - 2 * mu * sy + n * mu * mu) / mu"}
        for j in range(p):
            sums |= {f"z{j}": f"n * x{j} * rt", f"ze{j}": f"x{j} * (sy - n * mu)"}
        for j, k in pairs:
            sums[f"zz{j}_{k}"] = f"n * x{j} * x{k} * mu"
        clusters = at.groupBy("_id").agg(*[F.expr(f"sum({e})").alias(c) for c, e in sums.items()])
        c = f"({alpha!r}D / (1 + (n - 1) * {alpha!r}D))"
        scale = f"{(1 - alpha)!r}D"
        clusters = clusters.withColumns(
            {f"u{j}": F.expr(f"(ze{j} - {c} * z{j} * e) / {scale}") for j in range(p)}
        )
        aggs = [
            F.expr("sum(n)").alias("rows"),
            F.count(F.lit(1)).alias("clusters"),
            F.max("n").alias("widest"),
            F.expr("sum(n * (n - 1) / 2)").alias("pairs"),
            F.expr("sum(ee)").alias("ee"),
            F.expr("sum((e * e - ee) / 2)").alias("cross"),
        ]
        aggs += [F.expr(f"sum(u{j})").alias(f"u{j}") for j in range(p)]
        for j, k in pairs:
            aggs += [
                F.expr(f"sum((zz{j}_{k} - {c} * z{j} * z{k}) / {scale})").alias(f"b{j}_{k}"),
                F.expr(f"sum(u{j} * u{k})").alias(f"m{j}_{k}"),
            ]
        row = clusters.agg(*aggs).first()
        phi = float(row["ee"]) / (float(row["rows"]) - p)
        new_alpha = 0.0
        if corr == "exchangeable" and float(row["pairs"]) > p:
            new_alpha = float(row["cross"]) / (phi * (float(row["pairs"]) - p))
        return row, vector(row, "u", p), symmetric(row, "b", p), symmetric(row, "m", p), phi, new_alpha

    try:
        first = patterns.agg(F.sum("sy").alias("y"), F.sum(F.expr("n * exp(_off)")).alias("t")).first()
        if not first["y"]:
            raise ValueError("no events")
        beta, alpha = np.zeros(p), 0.0
        beta[0] = np.log(first["y"] / first["t"])
        converged, iteration, kept = False, 0, None
        for iteration in range(1, max_iter + 1):
            row, u, b, _, _, new_alpha = one_pass(beta, alpha)
            kept = independent(b) if kept is None else kept
            delta = inverse(b, kept) @ u
            beta = beta + delta
            moved, shift = float(np.max(np.abs(delta))), abs(new_alpha - alpha)
            # Correlation is taken in once the coefficients are near, as residuals far off mislead it.
            if moved < 0.5 and np.isfinite(new_alpha):
                # Beyond the values that a correlation of the widest cluster can have, go half of the way.
                lowest = -1 / (float(row["widest"]) - 1) if row["widest"] > 1 else -1.0
                while not lowest < new_alpha < 1:
                    new_alpha = (alpha + new_alpha) / 2
                alpha = new_alpha
            if moved < tol and shift < tol:
                converged = True
                break
        row, _, b, m, phi, _ = one_pass(beta, alpha)
        bread = inverse(b, kept)
        stats = {
            "n": float(row["rows"]),
            "clusters": float(row["clusters"]),
            "events": float(first["y"]),
            "scale": phi,
            "alpha": alpha,
        }
        return Fit(
            df.sparkSession,
            "poisson_gee",
            terms,
            beta,
            phi * bread,
            bread @ m @ bread,
            stats,
            converged=converged,
            iterations=iteration,
            kept=kept,
        )
    finally:
        patterns.unpersist()
