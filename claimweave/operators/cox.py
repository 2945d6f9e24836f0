"""Cox and conditional logistic regression by Newton steps over Spark aggregates.

Persons are first summed to distinct (stratum, time, event, covariates) patterns. Each Newton step is one
query: sums per (stratum, time), running risk-set sums, contributions per event time, one result row.
Only the gradient and the information matrix reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from claimweave.functions.tails import chi2_tail
from claimweave.operators.fits import Fit, independent, inverse, likelihood_tests, linear, symmetric, upper_triangle, vector, wald
from claimweave.operators.ordered import BUCKET, null_safe_join, running_sums, value_buckets

# Tied events up to this number are summed term by term; above it, all but the last terms use the
# midpoint expansion of the sum, whose error is below 1e-12 of the result.
_DIRECT = 64
_TAIL = 16
_WHOLE = 50_000


class _Problem:
    """Prepared patterns of one fit and the queries over them."""

    def __init__(
        self,
        df: DataFrame,
        time: str,
        event: str,
        xs: Sequence[str],
        strata: Sequence[str],
        weight: str | None,
        ties: str,
    ):
        if ties not in ("efron", "breslow"):
            raise ValueError("ties is 'efron' or 'breslow'")
        self.spark, self.ties, self.terms, self.p = df.sparkSession, ties, list(xs), len(xs)
        self.x = [f"x{j}" for j in range(self.p)]
        self.s = [f"_s{i}" for i in range(len(strata))]
        self.pairs = upper_triangle(self.p)
        keep = [time, event, *xs, *strata, *([weight] if weight else [])]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.dropna(subset=keep).select(
            *[F.col(c).alias(n) for c, n in zip(strata, self.s)],
            F.col(time).cast("double").alias("_t"),
            F.when(F.col(event) == 1, 1).otherwise(0).alias("_e"),
            *[F.col(c).cast("double").alias(n) for c, n in zip(xs, self.x)],
            w.alias("_w"),
        )
        patterns = rows.groupBy(*self.s, "_t", "_e", *self.x).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("ww")
        )
        # How patterns are laid out for the Newton steps follows from exact counts, so that what one task
        # holds is bounded: small strata are put together; otherwise rows stay spread as they are, since a
        # single time (the end of the study) may hold very many; and beyond _WHOLE distinct times the times
        # are cut into buckets, which are put together unless one of them is heavy.
        base = patterns.withColumn(BUCKET, F.lit(0)).persist(StorageLevel.MEMORY_AND_DISK)
        per_time = base.groupBy(*self.s, "_t").agg(F.count(F.lit(1)).alias("k"))
        per_stratum = per_time.groupBy(*self.s).agg(F.count(F.lit(1)).alias("times"), F.sum("k").alias("rows"))
        most = per_stratum.agg(F.max("times").alias("times"), F.max("rows").alias("rows"), F.sum("rows").alias("all")).first()
        self.cut = (most["times"] or 0) > _WHOLE
        laid = base
        if self.cut:
            laid = value_buckets(base.drop(BUCKET), "_t")
            heavy = laid.groupBy(*self.s, BUCKET).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
            if heavy <= max(_WHOLE, most["all"] // 64):
                laid = laid.repartition(*self.s, BUCKET)
        elif self.s and (most["rows"] or 0) <= _WHOLE:
            laid = base.repartition(*self.s)
        self.patterns = laid.persist(StorageLevel.MEMORY_AND_DISK)
        size = self.patterns.agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("_e")).alias("events"),
            *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in self.x],
            *[(F.max(c) - F.min(c)).alias(f"r{c}") for c in self.x],
        ).first()
        if not size["n"] or not size["events"]:
            raise ValueError("no complete rows with an event")
        if laid is not base:
            base.unpersist()
        self.n, self.events = int(size["n"]), int(size["events"])
        self.center, self.width = vector(size, "x", self.p), vector(size, "rx", self.p)

    def close(self) -> None:
        self.patterns.unpersist()

    def _rows(self, beta: np.ndarray) -> str:
        """SQL text of the patterns with centred covariates, linear predictor and hazard ratio."""
        shifted = ", ".join(f"{c} - ({float(m)!r}D) AS {c}" for c, m in zip(self.x, self.center))
        keys = "".join(f"{c}, " for c in self.s)
        return f"""
            SELECT *, exp(eta) AS hr FROM (
                SELECT *, {linear(beta, self.x)} AS eta FROM (
                    SELECT {keys}{BUCKET}, _t, _e, n, w, ww, {shifted} FROM {{patterns}}))"""

    def risk_table(self, beta: np.ndarray) -> DataFrame:
        """Risk-set and event sums per (stratum, time), with the tied-event sums of ``_tied``.

        Sums per time, then running sums from the latest time. If times are cut into buckets, bucket totals
        become offsets and the running sums stay inside a bucket.
        """
        at = lambda e: f"CASE WHEN _e = 1 THEN {e} ELSE 0D END"
        sums = {"s0": "w * hr"}
        fixed = {"d0": at("w * hr"), "d": at("n"), "dw": at("w"), "dl": at("w * eta")}
        for j in range(self.p):
            sums[f"s1_{j}"] = f"w * hr * x{j}"
            fixed |= {f"d1_{j}": at(f"w * hr * x{j}"), f"ex{j}": at(f"w * x{j}")}
        for j, k in self.pairs:
            sums[f"s2_{j}_{k}"] = f"w * hr * x{j} * x{k}"
            fixed[f"d2_{j}_{k}"] = at(f"w * hr * x{j} * x{k}")
        listed = lambda parts: ", ".join(parts)
        keys = listed([*self.s, BUCKET])
        within = f"PARTITION BY {listed(self.s)} " if self.s else ""
        frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
        same = " AND ".join(f"t.{c} <=> o.{c}" for c in [*self.s, BUCKET])
        kept = [*self.s, BUCKET, "_t", *fixed]
        # Each step is a frame of its own: a WITH clause is inlined after cached frames are put in, and fails on
        # a cached frame with an ordering.
        sql = self.spark.sql
        rows = sql(self._rows(beta), patterns=self.patterns)
        t = sql(f"SELECT {keys}, _t, {listed(f'sum({e}) AS {c}' for c, e in (sums | fixed).items())} FROM {{r}} GROUP BY {keys}, _t", r=rows)
        if self.cut:
            b = sql(f"SELECT {keys}, {listed(f'sum({c}) AS {c}' for c in sums)} FROM {{t}} GROUP BY {keys}", t=t)
            o = sql(
                f"""SELECT {keys}, {listed(f"coalesce(sum({c}) OVER later, 0D) AS {c}" for c in sums)}
                    FROM {{b}} WINDOW later AS ({within}ORDER BY {BUCKET} DESC {frame} 1 PRECEDING)""",
                b=b,
            )
            risk = sql(
                f"""SELECT {listed(f"t.{c}" for c in kept)}, {listed(f"o.{c} + sum(t.{c}) OVER inside AS {c}" for c in sums)}
                    FROM {{t}} t JOIN {{o}} o ON {same}
                    WINDOW inside AS (PARTITION BY {listed(f"t.{c}" for c in [*self.s, BUCKET])} ORDER BY t._t DESC
                                      {frame} CURRENT ROW)""",
                t=t, o=o,
            )
        else:
            risk = sql(
                f"""SELECT {listed(kept)}, {listed(f"sum({c}) OVER inside AS {c}" for c in sums)}
                    FROM {{t}} WINDOW inside AS ({within}ORDER BY _t DESC {frame} CURRENT ROW)""",
                t=t,
            )
        return sql(self._tied(), risk=risk)

    def _tied(self) -> str:
        """SQL text adding f1 = sum f, a1 = sum a f, f2 = sum f2, a2 = sum a f2, b2 = sum a2 f2, gl = sum log 1/f.

        The l-th of d tied events sees f = 1 / (s0 - a d0) with a = l / d. Writing c = d s0 / d0 turns all
        of these into g1 = sum 1/(c - l), g2 = sum 1/(c - l)2 and sum log(c - l).
        """
        ev = lambda f: f"CASE WHEN d > 0 THEN {f} ELSE 0D END"
        if self.ties == "breslow":
            return f"""SELECT *, {ev("d / s0")} AS f1, {ev("d / (s0 * s0)")} AS f2, 0D AS a1, 0D AS a2, 0D AS b2,
                {ev("d * ln(s0)")} AS gl, {ev("dw / d")} AS wbar FROM {{risk}}"""
        fold = lambda f: f"aggregate(args, 0D, (acc, v) -> acc + {f})"
        far = lambda f: f"CASE WHEN lo > 0 THEN {f} ELSE 0D END"
        g1 = far(
            "ln(hi / lw) + (pow(hi, -2) - pow(lw, -2)) / 24"
            " - 7 * (pow(hi, -4) - pow(lw, -4)) / 960 + 31 * (pow(hi, -6) - pow(lw, -6)) / 8064"
        )
        g2 = far(
            "1 / lw - 1 / hi + (pow(hi, -3) - pow(lw, -3)) / 12"
            " - 7 * (pow(hi, -5) - pow(lw, -5)) / 240 + 31 * (pow(hi, -7) - pow(lw, -7)) / 1344"
        )
        gl = far(
            "hi * ln(hi) - lw * ln(lw) - (hi - lw) - (1 / hi - 1 / lw) / 24"
            " + 7 * (pow(hi, -3) - pow(lw, -3)) / 2880 - 31 * (pow(hi, -5) - pow(lw, -5)) / 40320"
        )
        return f"""
            SELECT * EXCEPT (c, lo, lw, hi, args, g1, g2, g0),
                   {ev("g1 * d / d0")} AS f1,
                   {ev("(c * g1 - d) / d0")} AS a1,
                   {ev("g2 * d * d / (d0 * d0)")} AS f2,
                   {ev("(c * g2 - g1) * d / (d0 * d0)")} AS a2,
                   {ev("(c * c * g2 - 2 * c * g1 + d) / (d0 * d0)")} AS b2,
                   {ev("g0 + d * ln(d0 / d)")} AS gl,
                   {ev("dw / d")} AS wbar
            FROM (SELECT *, {fold("1 / v")} + {g1} AS g1, {fold("1 / (v * v)")} + {g2} AS g2, {fold("ln(v)")} + {gl} AS g0
                  FROM (SELECT *, c - lo + 0.5D AS lw, c + 0.5D AS hi,
                               CASE WHEN d > 0 THEN transform(sequence(CAST(lo AS INT), CAST(d AS INT) - 1), l -> c - l)
                                    ELSE array() END AS args
                        FROM (SELECT *, CASE WHEN d > 0 THEN d * s0 / d0 ELSE 1D END AS c,
                                     CASE WHEN d > {_DIRECT} THEN d - {_TAIL} ELSE 0D END AS lo FROM {{risk}})))"""

    def info_expr(self, j: int, k: int) -> str:
        return (
            f"wbar * (s2_{j}_{k} * f1 - d2_{j}_{k} * a1 - s1_{j} * s1_{k} * f2"
            f" + (s1_{j} * d1_{k} + d1_{j} * s1_{k}) * a2 - d1_{j} * d1_{k} * b2)"
        )

    @staticmethod
    def score_expr(j: int) -> str:
        return f"ex{j} - wbar * (s1_{j} * f1 - d1_{j} * a1)"

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and information at ``beta``."""
        aggs = [F.expr("sum(dl - wbar * gl)").alias("ll")]
        aggs += [F.expr(f"sum({self.score_expr(j)})").alias(f"u{j}") for j in range(self.p)]
        aggs += [F.expr(f"sum({self.info_expr(j, k)})").alias(f"i{j}_{k}") for j, k in self.pairs]
        row = self.risk_table(beta).filter("d > 0").agg(*aggs).first()
        return float(row["ll"]), vector(row, "u", self.p), symmetric(row, "i", self.p)

    def meat(self, beta: np.ndarray) -> np.ndarray:
        """Sum of squared weighted score residuals.

        A person carries the hazard increments of all earlier event times of the stratum, and of their own
        time: in full, or, if they are one of d tied events, with the share 1 - l/d of the l-th term.
        """
        p = range(self.p)
        risk = self.risk_table(beta)
        sums = {"h0": "wbar * f1"} | {f"h1_{j}": f"wbar * (s1_{j} * f2 - d1_{j} * a2)" for j in p}
        cum = running_sums(risk, self.s, "_t", sums)
        cum = cum.select(
            *self.s,
            BUCKET,
            "_t",
            *sums,
            F.expr("wbar * a1").alias("q0"),
            *[F.expr(f"wbar * (s1_{j} * a2 - d1_{j} * b2)").alias(f"q1_{j}") for j in p],
            *[
                F.expr(f"CASE WHEN d > 0 THEN (s1_{j} * f1 - d1_{j} * a1) / d ELSE 0D END").alias(f"m{j}")
                for j in p
            ],
        )
        rows = null_safe_join(self.spark.sql(self._rows(beta), patterns=self.patterns), cum, [*self.s, BUCKET, "_t"])
        rows = rows.withColumns(
            {
                f"u{j}": F.expr(f"_e * (x{j} - m{j}) - hr * (x{j} * (h0 - _e * q0) - (h1_{j} - _e * q1_{j}))")
                for j in p
            }
        )
        row = rows.agg(*[F.expr(f"sum(ww * u{j} * u{k})").alias(f"v{j}_{k}") for j, k in self.pairs]).first()
        return symmetric(row, "v", self.p)


def _newton(problem, max_iter: int, tol: float):
    """Coefficients, log-likelihood, information, the start's values, iterations, verdict and the kept terms."""
    beta = np.zeros(problem.p)
    ll, u, info = problem.step(beta)
    start, kept = (ll, u, info), independent(info)
    for iteration in range(1, max_iter + 1):
        delta = inverse(info, kept) @ u
        scale = 1.0
        new_ll, new_u, new_info = problem.step(beta + delta)
        while (not np.isfinite(new_ll) or new_ll < ll - 1e-9 * (abs(ll) + 1)) and scale > 1e-4:
            scale /= 2
            new_ll, new_u, new_info = problem.step(beta + scale * delta)
        beta = beta + scale * delta
        change = abs(new_ll - ll)
        ll, u, info = new_ll, new_u, new_info
        # Coefficients are judged by what they change in the linear predictor, whatever the covariates' units.
        if change <= tol * (abs(ll) + 1) and np.max(np.abs(scale * delta) * problem.width) < 1e-6:
            # A flat likelihood with a huge coefficient is separation, not convergence.
            unsure = np.square(beta) < np.diag(inverse(info, kept))
            return beta, ll, info, start, iteration, not np.any((np.abs(beta) * problem.width > 15) & unsure), kept
    return beta, ll, info, start, max_iter, False, kept


def cox(
    df: DataFrame,
    time: str,
    event: str,
    xs: Sequence[str],
    strata: Sequence[str] = (),
    weight: str | None = None,
    ties: str = "efron",
    robust: bool | None = None,
    max_iter: int = 30,
    tol: float = 1e-10,
) -> Fit:
    """Proportional-hazards regression. Rows with a missing model column are left out.

    ``robust`` defaults to on for a weighted fit. Terms that earlier ones determine are dropped: null in all tables.
    """
    problem = _Problem(df, time, event, xs, strata, weight, ties)
    try:
        beta, ll, info, (ll0, u0, info0), iterations, converged, kept = _newton(problem, max_iter, tol)
        var = inverse(info, kept)
        sandwich = None
        if robust if robust is not None else weight is not None:
            sandwich = var @ problem.meat(beta) @ var
        stats = {"n": problem.n, "events": problem.events}
        stats |= likelihood_tests(beta, info, u0, info0, ll0, ll, kept)
        if sandwich is not None:
            stats["robust_wald_chisq"] = wald(beta, sandwich)
        return Fit(
            problem.spark, "cox", list(xs), beta, var, sandwich, stats, converged=converged, iterations=iterations, kept=kept
        )
    finally:
        problem.close()


class _Sets:
    """Conditional likelihood of matched sets: the cases' odds over all ways to choose as many of the set.

    The sum over all choices of m rows is the elementary symmetric function e_m of the rows' odds. For m = 1 that is
    a plain sum, so such sets are one SQL aggregate. Otherwise a set's distinct covariate rows are multiplied up as
    polynomials in z, with derivatives: n equal rows are (1 + v z)^n, whose coefficient of z^j has derivatives j x and
    j^2 x x' times itself. Only the first m + 1 coefficients are kept. A set's distinct rows are one unit of
    work; sets without cases or of cases only say nothing and are left out.
    """

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], set_id: str):
        self.spark, self.p = df.sparkSession, len(xs)
        self.x, self.pairs = [f"x{j}" for j in range(self.p)], upper_triangle(self.p)
        rows = df.dropna(subset=[y, *xs, set_id]).select(
            F.col(set_id).alias("_set"), F.when(F.col(y) == 1, 1).otherwise(0).alias("_e"), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, self.x)]
        )
        patterns = rows.groupBy("_set", *self.x).agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("d"))
        sets = patterns.groupBy("_set").agg(F.sum("n").alias("_n"), F.sum("d").alias("m"))
        self.patterns = patterns.join(sets, "_set").persist(StorageLevel.MEMORY_AND_DISK)
        size = self.patterns.agg(
            F.sum("n").alias("n"), F.sum("d").alias("events"), F.count_if(F.expr("m > 1 AND m < _n")).alias("many"), F.max("m").alias("most"),
            *[F.avg(c).alias(c) for c in self.x], *[(F.max(c) - F.min(c)).alias(f"r{c}") for c in self.x],
        ).first()
        if not size["n"] or not size["events"]:
            self.close()
            raise ValueError("no complete rows with an event")
        self.n, self.events, self.many = int(size["n"]), int(size["events"]), int(size["many"])
        self.center, self.width = vector(size, "x", self.p), vector(size, "rx", self.p)

    def close(self) -> None:
        self.patterns.unpersist()

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and information at ``beta``."""
        near = self.patterns.filter("m > 0 AND m < _n").withColumns({c: F.col(c) - float(m) for c, m in zip(self.x, self.center)})
        near = near.withColumn("eta", F.expr(linear(beta, self.x)))
        odds = near.filter("m = 1").withColumn("v", F.expr("n * exp(eta)"))
        sums = {"s": "v", "l": "d * eta"} | {f"d{j}": f"d * x{j}" for j in range(self.p)} | {f"s{j}": f"v * x{j}" for j in range(self.p)}
        sums |= {f"s{j}_{k}": f"v * x{j} * x{k}" for j, k in self.pairs}
        each = odds.groupBy("_set").agg(*[F.expr(f"sum({e})").alias(c) for c, e in sums.items()])
        aggs = [F.expr("sum(l - ln(s))").alias("ll")] + [F.expr(f"sum(d{j} - s{j} / s)").alias(f"u{j}") for j in range(self.p)]
        aggs += [F.expr(f"sum(s{j}_{k} / s - s{j} * s{k} / (s * s))").alias(f"i{j}_{k}") for j, k in self.pairs]
        parts = each.agg(*aggs)
        if self.many:
            names = parts.columns
            found = near.filter("m > 1").select("_set", "m", "n", "d", "eta", *self.x).groupBy("_set").applyInPandas(
                _choices(self.p, names), ", ".join(f"{c} double" for c in names)
            )
            parts = parts.unionByName(found).agg(*[F.sum(c).alias(c) for c in names])
        row = parts.first()
        return float(row["ll"] or 0.0), vector(row, "u", self.p), symmetric(row, "i", self.p)


def _choices(p: int, names: list[str]):
    """Contribution of one set with several cases: log-likelihood, gradient, information."""
    pairs = upper_triangle(p)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = int(rows["m"].iloc[0])
        eta, n, d = rows["eta"].to_numpy(), rows["n"].to_numpy(), rows["d"].to_numpy(float)
        x = rows[[f"x{j}" for j in range(p)]].to_numpy(float)
        top = float(eta.max())
        # One row for each of the value, p first and p (p + 1) / 2 second derivatives of the coefficients 0..m.
        total = np.zeros((1 + p + len(pairs), m + 1))
        total[0, 0], log_scale = 1.0, 0.0
        for i in range(len(rows)):
            j = np.arange(min(int(n[i]), m) + 1)
            log_choose = np.array([math.lgamma(n[i] + 1) - math.lgamma(a + 1) - math.lgamma(n[i] - a + 1) for a in j])
            log_own = log_choose + j * (eta[i] - top)
            high = float(log_own.max())
            own = np.exp(log_own - high)
            by = lambda c, f=own: np.convolve(total[c], f)[: m + 1]
            first, second = own * j, own * j * j
            fresh = np.empty_like(total)
            plain, once, twice = by(0), by(0, first), by(0, second)
            fresh[0] = plain
            moved = [by(1 + a, first) for a in range(p)]
            for a in range(p):
                fresh[1 + a] = by(1 + a) + x[i, a] * once
            for q, (a, b) in enumerate(pairs):
                fresh[1 + p + q] = by(1 + p + q) + x[i, a] * moved[b] + x[i, b] * moved[a] + x[i, a] * x[i, b] * twice
            # Only the ratio at m counts; scaling by the largest value keeps it in range.
            size = float(fresh[0].max())
            total, log_scale = fresh / size, log_scale + high + math.log(size)
        whole = total[0, m]
        if not whole > 0:  # out of range: the step is halved
            return pd.DataFrame([dict.fromkeys(names, 0.0) | {"ll": -math.inf}])[names]
        first = total[1 : 1 + p, m] / whole
        out = {"ll": float(d @ eta) - (math.log(whole) + log_scale + m * top)}
        out |= {f"u{a}": float(d @ x[:, a]) - first[a] for a in range(p)}
        out |= {f"i{a}_{b}": total[1 + p + q, m] / whole - first[a] * first[b] for q, (a, b) in enumerate(pairs)}
        return pd.DataFrame([out])[names]

    return run


def conditional_logistic(df: DataFrame, y: str, xs: Sequence[str], set_id: str, max_iter: int = 30, tol: float = 1e-10) -> Fit:
    """Logistic regression conditional on matched sets, each with any number of cases (exact likelihood)."""
    sets = _Sets(df, y, xs, set_id)
    try:
        beta, ll, info, (ll0, u0, info0), iterations, converged, kept = _newton(sets, max_iter, tol)
        stats = {"n": sets.n, "events": sets.events} | likelihood_tests(beta, info, u0, info0, ll0, ll, kept)
        return Fit(
            sets.spark, "conditional_logistic", list(xs), beta, inverse(info, kept), None, stats, converged=converged, iterations=iterations, kept=kept
        )
    finally:
        sets.close()


def ph_test(
    df: DataFrame,
    fit: Fit,
    time: str,
    event: str,
    strata: Sequence[str] = (),
    weight: str | None = None,
    transform: str = "km",
    ties: str = "efron",
) -> DataFrame:
    """Score test of time-varying effects ``theta * g(t) * x``, per term and for all terms together.

    ``transform='km'`` uses one minus the pooled Kaplan-Meier curve just before t.
    """
    problem = _Problem(df, time, event, fit.terms, strata, weight, ties)
    try:
        p = problem.p
        risk = problem.risk_table(fit.beta)
        if transform == "km":
            pooled = (
                problem.patterns.groupBy(BUCKET, "_t")
                .agg(F.sum("n").alias("_n"), F.sum(F.expr("n * _e")).alias("_d"))
            )
            at_risk = running_sums(pooled, [], "_t", {"_y": "_n"}, descending=True)
            log_step = "CASE WHEN _d > 0 AND _d < _y THEN log1p(-_d / _y) ELSE 0D END"
            curve = running_sums(at_risk, [], "_t", {"_log": log_step}, inclusive=False)
            risk = risk.filter("d > 0").join(curve.select("_t", F.expr("1 - exp(_log)").alias("g")), "_t")
        else:
            forms = {"identity": "_t", "log": "ln(_t)"}
            risk = risk.filter("d > 0").withColumn("g", F.expr(forms[transform]))
        aggs = [F.expr(f"sum(g * ({problem.score_expr(j)}))").alias(f"u{j}") for j in range(p)]
        for j, k in problem.pairs:
            v = problem.info_expr(j, k)
            aggs += [
                F.expr(f"sum({v})").alias(f"a{j}_{k}"),
                F.expr(f"sum(g * {v})").alias(f"b{j}_{k}"),
                F.expr(f"sum(g * g * {v})").alias(f"c{j}_{k}"),
            ]
        row = risk.agg(*aggs).first()
        u, a, b, c = vector(row, "u", p), symmetric(row, "a", p), symmetric(row, "b", p), symmetric(row, "c", p)
        kept = np.ones(p, dtype=bool) if fit.kept is None else fit.kept
        inner = c - b @ inverse(a, kept) @ b
        rows = []
        for j, term in enumerate(fit.terms):
            chisq = float(u[j] ** 2 / inner[j, j]) if kept[j] and inner[j, j] > 0 else None
            rows.append((term, chisq, 1, None if chisq is None else chi2_tail(chisq, 1)))
        total, free = float(u @ inverse(inner, kept) @ u), max(int(kept.sum()), 1)
        rows.append(("GLOBAL", total, free, chi2_tail(total, free)))
        return problem.spark.createDataFrame(rows, "term string, chisq double, df int, p_value double")
    finally:
        problem.close()


def fit_overview(fits: Mapping[str, Fit]) -> DataFrame:
    """Fit-level statistics of several models in one long table."""
    out: DataFrame | None = None
    for name, fit in fits.items():
        part = fit.summary().withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fits given")
    return out


def risk_score(df: DataFrame, fit: Fit, name: str = "risk") -> DataFrame:
    """Add the fitted linear predictor as a plain column expression."""
    return df.withColumn(name, F.expr(linear(fit.beta, [f"CAST(`{c}` AS DOUBLE)" for c in fit.terms])))
