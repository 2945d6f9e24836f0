"""Registered queries: tables, curves, tests and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.clean import flag
from claimweave.operators import describe, matching, survival, weights
from claimweave.operators.cox import conditional_logistic, cox, fit_overview, ph_test, risk_score
from claimweave.operators.fits import ratio_table
from claimweave.operators.regression import logistic, poisson_gee
from claimweave.plans import propensity_study
from claimweave.plans.driver_tables import (
    SQL_PF, SQL_SURVIVAL, panel_frame, query, rounded, sql_chi2, sql_p, sql_sweep, survival_frame, table, union_all,
)
from claimweave.session import held

TIMES = (0, 400, 800, 1200, 1600, 2000, 2400)


@query(
    "table_one",
    f"""WITH {SQL_SURVIVAL}, s AS (SELECT CAST(x AS VARCHAR) AS stratum, * FROM sf UNION ALL SELECT 'Overall', * FROM sf),
    c AS (SELECT stratum, 'rich' AS variable, CAST(rich AS VARCHAR) AS level FROM s UNION ALL SELECT stratum, 'segment', segment FROM s),
    k AS (SELECT variable, level, stratum, count(*) AS n FROM c WHERE level IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY variable, stratum) * 100 AS pct FROM k),
    v AS (SELECT stratum, 'balance' AS variable, balance AS v FROM s UNION ALL SELECT stratum, 'ft', ft FROM s),
    q AS (SELECT variable, stratum, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS median FROM v GROUP BY ALL)
    SELECT 'categorical' AS section, variable, level, stratum, 'n' AS statistic, CAST(n AS DOUBLE) AS value FROM p
    UNION ALL SELECT 'categorical', variable, level, stratum, 'pct', round(pct, 6) FROM p
    UNION ALL SELECT 'continuous', variable, NULL, stratum, 'mean', round(mean, 6) FROM q
    UNION ALL SELECT 'continuous', variable, NULL, stratum, 'sd', round(sd, 6) FROM q
    UNION ALL SELECT 'continuous', variable, NULL, stratum, 'median', round(median, 6) FROM q""",
)
def table_one(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.table_one(survival_frame(spark, sf), "x", ["rich", "segment"], ["balance", "ft"]))


def _smd_sql(w: str) -> str:
    part = lambda v, kind, var: f"""SELECT '{v}' AS variable, '{kind}' AS kind, count({v}) FILTER (treat = 0) AS n_0,
        count({v}) FILTER (treat = 1) AS n_1, m0, m1, {var.format(g=0)} AS v0, {var.format(g=1)} AS v1 FROM sf, (
        SELECT sum({w} * {v}) FILTER (treat = 0) / sum({w}) FILTER (treat = 0) AS m0,
               sum({w} * {v}) FILTER (treat = 1) / sum({w}) FILTER (treat = 1) AS m1 FROM sf) GROUP BY m0, m1"""  # noqa: E731
    cont = (
        "sum({w} * pow({v} - m{{g}}, 2)) FILTER (treat = {{g}}) / sum({w}) FILTER (treat = {{g}})"
        " * count(*) FILTER (treat = {{g}}) / (count(*) FILTER (treat = {{g}}) - 1)"
    )
    rows = " UNION ALL ".join(
        [part(v, "continuous", cont.format(w=w, v=v)) for v in ("balance", "ft")]
        + [part(v, "binary", "m{g} * (1 - m{g})") for v in ("x", "rich")]
    )
    return f"""WITH {SQL_SURVIVAL}, r AS ({rows}) SELECT variable, kind, n_0, n_1, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1,
        round(sqrt(v0), 6) AS sd_0, round(sqrt(v1), 6) AS sd_1, round(abs(m1 - m0) / sqrt((v0 + v1) / 2), 6) AS smd FROM r"""


@query("smd", _smd_sql("1.0::DOUBLE"))
def smd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.baseline_smd(survival_frame(spark, sf), "treat", ["balance", "ft"], ["x", "rich"]))


@query("weighted_smd", _smd_sql("w"))
def weighted_smd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.baseline_smd(survival_frame(spark, sf), "treat", ["balance", "ft"], ["x", "rich"], "w"))


@query(
    "incidence",
    f"""WITH {SQL_SURVIVAL} SELECT segment, count(*) AS tot_n, CAST(sum(ot) AS BIGINT) AS tot_event, sum(ft) AS tot_time,
    min(ft) AS min_time, max(ft) AS max_time, round(sum(ot) / sum(ft) * 100000, 6) AS rate FROM sf GROUP BY 1""",
)
def incidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.incidence(survival_frame(spark, sf), "ft", "ot", ["segment"], 100000))


@query(
    "weighted_incidence",
    f"""WITH {SQL_SURVIVAL} SELECT treat, round(sum(w), 6) AS tot_n, round(sum(w * ot), 6) AS tot_event, round(sum(w * ft), 6) AS tot_time,
    min(ft) AS min_time, max(ft) AS max_time, round(sum(w * ot) / sum(w * ft) * 100, 6) AS rate FROM sf GROUP BY 1""",
)
def weighted_incidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.incidence(survival_frame(spark, sf), "ft", "ot", ["treat"], 100, "w"))


def _km_sql(by: str, w: str, count: str) -> str:
    return f"""{SQL_SURVIVAL}, tt AS (SELECT {by}, ft AS time, sum({w}) AS n, sum({w} * ot) AS d FROM sf GROUP BY 1, 2),
      rk AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY time DESC) AS r FROM tt),
      st AS (SELECT *, d > 0 AND r - d <= 1e-12 * r AS fin FROM rk),
      km AS (SELECT {by}, time, r AS n_risk, d AS n_event, n - d AS n_censor,
        exp(sum(CASE WHEN fin THEN 0 ELSE ln(1 - d / r) END) OVER ww) AS s, max(CAST(fin AS INT)) OVER ww AS z,
        sum(CASE WHEN fin THEN 0 ELSE d / (r * (r - d)) END) OVER ww AS gw
        FROM (SELECT {by}, time, CAST(n AS DOUBLE) AS n, CAST(d AS DOUBLE) AS d, CAST(r AS DOUBLE) AS r, fin FROM st)
        WINDOW ww AS (PARTITION BY {by} ORDER BY time)),
      curve AS (SELECT {by}, time, CAST(n_risk AS {count}) AS n_risk, CAST(n_event AS {count}) AS n_event,
        CAST(n_censor AS {count}) AS n_censor, CASE WHEN z = 1 THEN 0 ELSE s END AS surv,
        CASE WHEN z = 0 THEN s * sqrt(gw) END AS std_err, CASE WHEN z = 0 THEN exp(ln(s) - 1.959963984540054 * sqrt(gw)) END AS lower,
        CASE WHEN z = 0 THEN least(exp(ln(s) + 1.959963984540054 * sqrt(gw)), 1) END AS upper FROM km)"""


def _curve(by: str, kind: str) -> str:
    counts = "n_risk, n_event, n_censor" if kind == "BIGINT" else ", ".join(
        f"round({c}, 6) AS {c}" for c in ("n_risk", "n_event", "n_censor")
    )
    return f"""SELECT {by}, time, {counts}, round(surv, 6) AS surv, round(std_err, 6) AS std_err, round(lower, 6) AS lower,
        round(upper, 6) AS upper FROM curve"""


@query("km", f"WITH {_km_sql('segment', '1', 'BIGINT')} {_curve('segment', 'BIGINT')}")
def km(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.kaplan_meier(survival_frame(spark, sf), "ft", "ot", ["segment"]))


@query("km_weighted", f"WITH {_km_sql('treat', 'w', 'DOUBLE')} {_curve('treat', 'DOUBLE')}")
def km_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.kaplan_meier(survival_frame(spark, sf), "ft", "ot", ["treat"], "w"))


@query(
    "km_weighted_robust",
    f"""WITH {_km_sql('treat', 'w', 'DOUBLE')},
      g AS (SELECT c.treat, c.time, c.surv, sum(sf.w * sf.w * pow(coalesce(a.a, 0) - CASE WHEN sf.ot = 1 AND sf.ft <= c.time THEN 1 / (own.r - own.d) ELSE 0 END, 2)) AS v
        FROM curve c JOIN sf ON sf.treat = c.treat
        JOIN (SELECT treat, time, r, d, sum(d / (r * (r - d))) FILTER (NOT fin) OVER (PARTITION BY treat ORDER BY time) AS a FROM st) a
          ON a.treat = c.treat AND a.time = least(c.time, sf.ft)
        JOIN st own ON own.treat = sf.treat AND own.time = sf.ft
        WHERE c.lower IS NOT NULL GROUP BY ALL)
    SELECT c.treat, c.time, round(n_risk, 6) AS n_risk, round(n_event, 6) AS n_event, round(n_censor, 6) AS n_censor, round(c.surv, 6) AS surv,
      round(c.surv * sqrt(v), 6) AS std_err, round(exp(ln(c.surv) - 1.959963984540054 * sqrt(v)), 6) AS lower,
      round(least(exp(ln(c.surv) + 1.959963984540054 * sqrt(v)), 1), 6) AS upper FROM curve c LEFT JOIN g ON g.treat = c.treat AND g.time = c.time""",
)
def km_weighted_robust(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted curves with infinitesimal-jackknife limits."""
    return rounded(survival.kaplan_meier(survival_frame(spark, sf), "ft", "ot", ["treat"], "w", robust=True))


def _life_sql(extend: bool) -> str:
    times = ", ".join(f"({t}::DOUBLE)" for t in TIMES)
    return f"""WITH {SQL_SURVIVAL}, grid(time) AS (VALUES {times}), g AS (SELECT segment, max(ft) AS last FROM sf GROUP BY 1),
      {_km_sql('segment', '1', 'BIGINT').split(SQL_SURVIVAL + ', ')[1]}
      SELECT g.segment, grid.time, (SELECT count(*) FROM sf WHERE sf.segment = g.segment AND ft >= grid.time) AS n_risk,
      (SELECT CAST(coalesce(sum(ot), 0) AS BIGINT) FROM sf WHERE sf.segment = g.segment AND ft <= grid.time) AS cum_event,
      round(coalesce((SELECT min(surv) FROM curve c WHERE c.segment = g.segment AND c.time <= grid.time), 1), 6) AS surv
      FROM g, grid {'' if extend else 'WHERE grid.time <= g.last'}"""


@query("life_table", _life_sql(False))
def life_table(spark: SparkSession, sf: str) -> DataFrame:
    curve = survival.kaplan_meier(survival_frame(spark, sf), "ft", "ot", ["segment"])
    return rounded(survival.life_table(curve, TIMES, ["segment"]))


@query("risk_table", _life_sql(True))
def risk_table(spark: SparkSession, sf: str) -> DataFrame:
    curve = survival.kaplan_meier(survival_frame(spark, sf), "ft", "ot", ["segment"])
    return rounded(survival.life_table(curve, TIMES, ["segment"], extend=True))


def _logrank_sql(by: str) -> str:
    return f"""WITH {SQL_SURVIVAL}, g AS (SELECT {by} AS g, count(*) AS n, sum(ot) AS o FROM sf GROUP BY 1),
      t AS (SELECT ft, CAST(sum(ot) AS DOUBLE) AS d FROM sf GROUP BY 1 HAVING sum(ot) > 0),
      r AS (SELECT t.ft, t.d, g.g, CAST(count(*) FILTER ({by} = g.g) AS DOUBLE) AS ng, CAST(count(*) AS DOUBLE) AS nn
            FROM t JOIN sf ON sf.ft >= t.ft, g GROUP BY 1, 2, 3),
      e AS (SELECT g, sum(d * ng / nn) AS e, sum(CASE WHEN nn > 1 THEN d * (nn - d) / (nn - 1) ELSE 0 END * ng / nn * (1 - ng / nn)) AS v
            FROM r GROUP BY 1)
      SELECT CAST(g AS VARCHAR) AS level, n, CAST(o AS BIGINT) AS observed, round(e, 6) AS expected, round(v, 6) AS variance"""


@query(
    "logrank",
    _logrank_sql("treat") + f", round(pow(o - e, 2) / v, 6) AS chisq, 1 AS df, round({sql_chi2('pow(o - e, 2) / v', 1)}, 6) AS p_value FROM g JOIN e USING (g)",
)
def logrank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.logrank(survival_frame(spark, sf), "ft", "ot", "treat", [0, 1]))


def _logrank_groups_sql() -> str:
    """Observed less expected and their covariance for the first four of five segments, then the quadratic form."""
    gap = ", ".join(f"sum(gap) FILTER (i = {i}) AS m{i}_4" for i in range(4))
    cells = [f"sum(c) FILTER (i = {i} AND j = {j}) AS m{i}_{j}" for i in range(4) for j in range(i, 4)]
    system = f"SELECT 1 AS one, m.*, u.*, 0::DOUBLE AS m4_4 FROM (SELECT {', '.join(cells)} FROM cv) m, (SELECT {gap} FROM nb) u"
    base = _logrank_sql("segment").split("SELECT CAST(g AS VARCHAR)")[0]
    shown = _logrank_sql("segment")[len(base) :]
    return f"""{base}, nb AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, o - e AS gap FROM g JOIN e USING (g)),
      cv AS (SELECT a.i, b.i AS j, sum(CASE WHEN x.nn > 1 THEN x.d * (x.nn - x.d) / (x.nn - 1) ELSE 0 END * (CASE WHEN a.i = b.i THEN x.ng / x.nn ELSE 0 END - x.ng * y.ng / (x.nn * x.nn))) AS c
        FROM r x JOIN r y ON x.ft = y.ft JOIN nb a ON a.g = x.g JOIN nb b ON b.g = y.g WHERE a.i <= b.i GROUP BY 1, 2),
      q AS (SELECT -m4_4 AS q FROM ({sql_sweep(4, system, "one")}))
      {shown}, round(q, 6) AS chisq, 4 AS df, round({sql_chi2("q", 4)}, 6) AS p_value FROM g JOIN e USING (g), q"""


@query("logrank_groups", _logrank_groups_sql())
def logrank_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.logrank(survival_frame(spark, sf), "ft", "ot", "segment"))


def _coefficients(fit, se: str = "auto") -> DataFrame:
    return rounded(fit.tidy(se))


# All columns of a coefficient table, from rows of term, b and s.
SHOWN = f"""term, round(b, 6) AS estimate, round(s, 6) AS std_err, round(b / s, 6) AS statistic, round({sql_p("b / s")}, 6) AS p_value,
    round(b - 1.959963984540054 * s, 6) AS lower, round(b + 1.959963984540054 * s, 6) AS upper"""


@query(
    "logit_binary",
    f"""WITH {SQL_SURVIVAL}, k AS (SELECT count(*) FILTER (x = 1 AND ot = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND ot = 0)::DOUBLE AS b,
      count(*) FILTER (x = 0 AND ot = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND ot = 0)::DOUBLE AS d FROM sf)
    SELECT {SHOWN} FROM (SELECT '(Intercept)' AS term, ln(c / d) AS b, sqrt(1 / c + 1 / d) AS s FROM k UNION ALL
      SELECT 'x', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM k)""",
)
def logit_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(logistic(survival_frame(spark, sf), "ot", ["x"]))


@query(
    "odds_ratio_table",
    f"""WITH {SQL_SURVIVAL}, k AS (SELECT count(*) FILTER (rich = 1 AND ot = 1)::DOUBLE AS a, count(*) FILTER (rich = 1 AND ot = 0)::DOUBLE AS b,
      count(*) FILTER (rich = 0 AND ot = 1)::DOUBLE AS c, count(*) FILTER (rich = 0 AND ot = 0)::DOUBLE AS d FROM sf),
    e AS (SELECT '(Intercept)' AS term, ln(c / d) AS b, sqrt(1 / c + 1 / d) AS s FROM k UNION ALL
      SELECT 'rich', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM k)
    SELECT term, round(exp(b), 6) AS ratio, round(exp(b - 1.959963984540054 * s), 6) AS lower,
    round(exp(b + 1.959963984540054 * s), 6) AS upper, round({sql_p("b / s")}, 6) AS p_value FROM e""",
)
def odds_ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio_table(logistic(survival_frame(spark, sf), "ot", ["rich"])))


SQL_LOGIT = f"""WITH RECURSIVE {SQL_SURVIVAL}, c AS (SELECT x, rich, count(*)::DOUBLE AS n, sum(ot)::DOUBLE AS s FROM sf GROUP BY 1, 2),
    it AS (SELECT 0 AS k, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS g, 0::DOUBLE AS va, 0::DOUBLE AS vb, 0::DOUBLE AS vg UNION ALL
      SELECT k + 1, a + ((p * r - q * q) * u0 + (m * q - l * r) * u1 + (l * q - m * p) * u2) / det,
        b + ((m * q - l * r) * u0 + (h * r - m * m) * u1 + (l * m - h * q) * u2) / det,
        g + ((l * q - m * p) * u0 + (l * m - h * q) * u1 + (h * p - l * l) * u2) / det,
        (p * r - q * q) / det, (h * r - m * m) / det, (h * p - l * l) / det
      FROM (SELECT *, h * (p * r - q * q) - l * (l * r - m * q) + m * (l * q - m * p) AS det FROM (
        SELECT k, a, b, g, sum(s - n * mu) AS u0, sum((s - n * mu) * x) AS u1, sum((s - n * mu) * rich) AS u2, sum(v) AS h,
          sum(v * x) AS l, sum(v * rich) AS m, sum(v * x) AS p, sum(v * x * rich) AS q, sum(v * rich) AS r
        FROM (SELECT *, n * mu * (1 - mu) AS v FROM (SELECT *, 1 / (1 + exp(-(a + b * x + g * rich))) AS mu FROM it, c WHERE k < 15))
        GROUP BY k, a, b, g)))
    SELECT {SHOWN} FROM (SELECT '(Intercept)' AS term, a AS b, sqrt(va) AS s FROM it WHERE k = 15 UNION ALL
      SELECT 'x', b, sqrt(vb) FROM it WHERE k = 15 UNION ALL SELECT 'rich', g, sqrt(vg) FROM it WHERE k = 15)"""


@query("logit_multi", SQL_LOGIT)
def logit_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(logistic(survival_frame(spark, sf), "ot", ["x", "rich"]))


@query("logit_profile_limits")
def logit_profile_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Odds ratios with profile-likelihood limits."""
    return ratio_table(logistic(survival_frame(spark, sf), "ot", ["x", "rich"], profile=True), ci="profile")


SQL_PAIRS = f"""{SQL_SURVIVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY rich, treat, ot ORDER BY md5(id || ':11'), id) AS q,
      count(*) FILTER (ot = 1) OVER (PARTITION BY rich, treat) AS n1, count(*) FILTER (ot = 0) OVER (PARTITION BY rich, treat) AS n0 FROM sf),
    pr AS (SELECT a.x AS x1, b.x AS x0 FROM r a JOIN r b ON a.rich = b.rich AND a.treat = b.treat AND a.q = b.q
      WHERE a.ot = 1 AND b.ot = 0 AND a.q <= least(a.n1, a.n0))"""


@query(
    "clogit_pairs",
    f"""WITH {SQL_PAIRS}, k AS (SELECT count(*) FILTER (x1 = 1 AND x0 = 0)::DOUBLE AS f, count(*) FILTER (x1 = 0 AND x0 = 1)::DOUBLE AS g FROM pr)
    SELECT {SHOWN} FROM (SELECT 'x' AS term, ln(f / g) AS b, sqrt(1 / f + 1 / g) AS s FROM k)""",
)
def clogit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional logistic regression on 1:1 matched pairs."""
    frame = survival_frame(spark, sf).select("id", "ot", "rich", "treat", "x")
    pairs = matching.frequency_match(frame, "ot", ["rich", "treat"], 1, 11, "id")
    return _coefficients(conditional_logistic(pairs, "ot", ["x"], "gg"))


@query(
    "clogit_sets",
    f"""WITH RECURSIVE {SQL_SURVIVAL}, s AS (SELECT id // 5 AS g, sum(x) AS n1, count(*) - sum(x) AS n0, sum(ot) AS m, sum(ot * x) AS a FROM sf GROUP BY 1),
      c AS (SELECT g, a, j, lgamma(n1 + 1) - lgamma(j + 1) - lgamma(n1 - j + 1) + lgamma(n0 + 1) - lgamma(m - j + 1) - lgamma(n0 - m + j + 1) AS lc
        FROM (SELECT g, a, n1::DOUBLE AS n1, n0::DOUBLE AS n0, m::DOUBLE AS m, unnest(range(CAST(greatest(0, m - n0) AS BIGINT), CAST(least(m, n1) + 1 AS BIGINT)))::DOUBLE AS j FROM s)),
      it AS (SELECT 0 AS k, 0::DOUBLE AS b, 0::DOUBLE AS info UNION ALL
        SELECT k + 1, b + sum(a - s1 / s0) / sum(s2 / s0 - pow(s1 / s0, 2)), sum(s2 / s0 - pow(s1 / s0, 2)) FROM (
          SELECT k, b, g, any_value(a) AS a, sum(v) AS s0, sum(v * j) AS s1, sum(v * j * j) AS s2 FROM (SELECT it.k, it.b, c.*, exp(lc + b * j) AS v FROM it, c WHERE k < 15) GROUP BY k, b, g)
        GROUP BY k, b)
    SELECT 'x' AS term, round(b, 6) AS estimate, round(1 / sqrt(info), 6) AS std_err, round(b * sqrt(info), 6) AS statistic, round({sql_p("b * sqrt(info)")}, 6) AS p_value,
      round(b - 1.959963984540054 / sqrt(info), 6) AS lower, round(b + 1.959963984540054 / sqrt(info), 6) AS upper FROM it WHERE k = 15""",
)
def clogit_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional logistic regression on sets of up to five persons with any number of cases."""
    frame = survival_frame(spark, sf).select("ot", "x", F.floor(F.col("id") / 5).alias("g"))
    return rounded(conditional_logistic(frame, "ot", ["x"], "g").tidy())


def _cox_terms(strata: str = "", w: str = "1.0::DOUBLE") -> str:
    """Per event time: weighted risk-set and event sums of a 0/1 covariate, one row per tied event."""
    s, join = (f"{strata}, ", f"AND sf.{strata} = e.{strata}") if strata else ("", "")
    es = f"e.{strata}, " if strata else ""
    return f"""{SQL_SURVIVAL}, e AS (SELECT {s}ft, count(*)::DOUBLE AS d, sum({w}) AS dw, sum({w} * x) AS dx FROM sf WHERE ot = 1 GROUP BY ALL),
      k AS (SELECT {es}e.ft, d, dw, dx, sum({w} * (1 - x)) AS n0, sum({w} * x) AS n1 FROM e JOIN sf ON sf.ft >= e.ft {join} GROUP BY ALL),
      l AS (SELECT *, dw / d AS wb, i / d AS a FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS i FROM k)),
      it AS (SELECT 0 AS k, 0::DOUBLE AS b, 0::DOUBLE AS info UNION ALL
        SELECT k + 1, b + sum(dx / d - wb * p) / sum(wb * (p - p * p)), sum(wb * (p - p * p)) FROM (
          SELECT *, (n1 - a * dx) * exp(b) / (n0 - a * (dw - dx) + (n1 - a * dx) * exp(b)) AS p FROM (SELECT it.k, b, info, d, dx, dw, wb, a, n0, n1 FROM it, l WHERE it.k < 15))
        GROUP BY k, b)"""


SQL_COX_OUT = f"SELECT {SHOWN} FROM (SELECT 'x' AS term, b, 1 / sqrt(info) AS s FROM it WHERE k = 15)"


@query("cox_uni", f"WITH RECURSIVE {_cox_terms()} {SQL_COX_OUT}")
def cox_uni(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(cox(survival_frame(spark, sf), "ft", "ot", ["x"]))


@query("cox_strata", f"WITH RECURSIVE {_cox_terms('nation')} {SQL_COX_OUT}")
def cox_strata(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(cox(survival_frame(spark, sf), "ft", "ot", ["x"], strata=["nation"]))


@query(
    "cox_weighted",
    f"""WITH RECURSIVE {_cox_terms(w="w")}, fin AS (SELECT b, info FROM it WHERE k = 15),
      f AS (SELECT l.ft, wb, a, d, 1 / (n0 - a * (dw - dx) + (n1 - a * dx) * exp(b)) AS f,
        (n1 - a * dx) * exp(b) / (n0 - a * (dw - dx) + (n1 - a * dx) * exp(b)) AS p FROM l, fin),
      hz AS (SELECT ft, sum(wb * f) AS h0, sum(wb * p * f) AS h1, sum(a * wb * f) AS q0, sum(a * wb * p * f) AS q1, avg(p) AS m FROM f GROUP BY 1),
      c AS (SELECT sf.id, sum(h0) AS h0, sum(h1) AS h1 FROM sf JOIN hz ON hz.ft <= sf.ft GROUP BY 1),
      u AS (SELECT sf.w, ot * (x - coalesce(m, 0)) - exp(b * x) * (x * (coalesce(c.h0, 0) - ot * coalesce(q0, 0))
        - (coalesce(c.h1, 0) - ot * coalesce(q1, 0))) AS u FROM sf LEFT JOIN c USING (id) LEFT JOIN hz USING (ft), fin)
    SELECT {SHOWN}, robust_se FROM (SELECT 'x' AS term, b, 1 / sqrt(info) AS s, round((SELECT sqrt(sum(w * w * u * u)) FROM u) / info, 6) AS robust_se FROM fin)""",
)
def cox_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted Cox regression with model-based and sandwich standard errors."""
    fit = cox(survival_frame(spark, sf), "ft", "ot", ["x"], weight="w")
    robust = fit.tidy("robust").select("term", F.col("std_err").alias("robust_se"))
    return rounded(_coefficients(fit, "model").join(robust, "term"))


SQL_COX_TWO = f"""WITH RECURSIVE {SQL_SURVIVAL}, e AS (SELECT ft, count(*)::DOUBLE AS d, sum(x) AS ex, sum(rich) AS er FROM sf WHERE ot = 1 GROUP BY 1),
      c AS (SELECT e.ft, e.d, e.ex, e.er, sf.x, sf.rich, count(*)::DOUBLE AS n, count(*) FILTER (sf.ft = e.ft AND ot = 1)::DOUBLE AS v
        FROM e JOIN sf ON sf.ft >= e.ft GROUP BY ALL),
      l AS (SELECT ft, d, ex / d AS ex, er / d AS er, i, x, rich, n - i / d * v AS m FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS i FROM c)),
      it AS (SELECT 0 AS k, 0::DOUBLE AS b, 0::DOUBLE AS g, 0::DOUBLE AS vb, 0::DOUBLE AS vg UNION ALL
        SELECT k + 1, b + (irr * ux - ixr * ur) / det, g + (ixx * ur - ixr * ux) / det, irr / det, ixx / det FROM (
          SELECT *, ixx * irr - ixr * ixr AS det FROM (
            SELECT k, b, g, sum(ex - sx / s) AS ux, sum(er - sr / s) AS ur, sum(sx / s - sx * sx / (s * s)) AS ixx,
              sum(sr / s - sr * sr / (s * s)) AS irr, sum(sxr / s - sx * sr / (s * s)) AS ixr FROM (
              SELECT k, b, g, ft, i, ex, er, sum(z) AS s, sum(z * x) AS sx, sum(z * rich) AS sr, sum(z * x * rich) AS sxr FROM (
                SELECT *, m * exp(b * x + g * rich) AS z FROM it, l WHERE k < 12) GROUP BY ALL) GROUP BY k, b, g)))"""


@query(
    "cox_multi",
    f"""{SQL_COX_TWO}
    SELECT {SHOWN} FROM (SELECT 'x' AS term, b, sqrt(vb) AS s FROM it WHERE k = 12 UNION ALL SELECT 'rich', g, sqrt(vg) FROM it WHERE k = 12)""",
)
def cox_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(cox(survival_frame(spark, sf), "ft", "ot", ["x", "rich"]))


@query(
    "cox_zph",
    f"""{SQL_COX_TWO}, dn AS (SELECT ft, count(*)::DOUBLE AS n, sum(ot)::DOUBLE AS d FROM sf GROUP BY 1),
      rk AS (SELECT *, sum(n) OVER (ORDER BY ft DESC) AS r FROM dn),
      gt AS (SELECT ft, 1 - exp(coalesce(sum(CASE WHEN d > 0 AND d < r THEN ln(1 - d / r) ELSE 0 END) OVER (
        ORDER BY ft ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS h FROM rk),
      lf AS (SELECT ft, i, ex, er, sum(z) AS s, sum(z * x) AS sx, sum(z * rich) AS sr, sum(z * x * rich) AS sxr
        FROM (SELECT l.*, m * exp(b * x + g * rich) AS z FROM l, it WHERE k = 12) GROUP BY ft, i, ex, er),
      t AS (SELECT h, ex - sx / s AS u1, er - sr / s AS u2, sx / s - pow(sx / s, 2) AS v11, sr / s - pow(sr / s, 2) AS v22, sxr / s - sx * sr / (s * s) AS v12
        FROM lf JOIN gt USING (ft)),
      w AS (SELECT sum(h * u1) AS u1, sum(h * u2) AS u2, sum(v11) AS a11, sum(v12) AS a12, sum(v22) AS a22, sum(h * v11) AS b11, sum(h * v12) AS b12,
        sum(h * v22) AS b22, sum(h * h * v11) AS c11, sum(h * h * v12) AS c12, sum(h * h * v22) AS c22 FROM t),
      n AS (SELECT u1, u2, c11 - (b11 * (a22 * b11 - a12 * b12) + b12 * (a11 * b12 - a12 * b11)) / (a11 * a22 - a12 * a12) AS i11,
        c12 - (b11 * (a22 * b12 - a12 * b22) + b12 * (a11 * b22 - a12 * b12)) / (a11 * a22 - a12 * a12) AS i12,
        c22 - (b12 * (a22 * b12 - a12 * b22) + b22 * (a11 * b22 - a12 * b12)) / (a11 * a22 - a12 * a12) AS i22 FROM w),
      z AS (SELECT 'x' AS term, u1 * u1 / i11 AS q, 1 AS df FROM n UNION ALL SELECT 'rich', u2 * u2 / i22, 1 FROM n
        UNION ALL SELECT 'GLOBAL', (u1 * u1 * i22 - 2 * u1 * u2 * i12 + u2 * u2 * i11) / (i11 * i22 - i12 * i12), 2 FROM n)
    SELECT term, round(q, 5) AS chisq, df, round(CASE WHEN df = 1 THEN {sql_chi2("q", 1)} ELSE {sql_chi2("q", 2)} END, 5) AS p_value FROM z""",
)
def cox_zph(spark: SparkSession, sf: str) -> DataFrame:
    """Proportional-hazards test of a two-term model."""
    frame = survival_frame(spark, sf)
    fit = cox(frame, "ft", "ot", ["x", "rich"])
    return rounded(ph_test(frame, fit, "ft", "ot"), 5)


@query(
    "cox_zph_uni",
    f"""WITH RECURSIVE {_cox_terms()}, dn AS (SELECT ft, count(*)::DOUBLE AS n, sum(ot)::DOUBLE AS d FROM sf GROUP BY 1),
      rk AS (SELECT *, sum(n) OVER (ORDER BY ft DESC) AS r FROM dn),
      g AS (SELECT ft, 1 - exp(coalesce(sum(CASE WHEN d > 0 AND d < r THEN ln(1 - d / r) ELSE 0 END) OVER (
        ORDER BY ft ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM rk),
      t AS (SELECT g.g, dx / l.d - p AS u, p - p * p AS v FROM (SELECT l.*, (n1 - a * dx) * exp(b) / (n0 - a * (dw - dx) + (n1 - a * dx) * exp(b)) AS p
        FROM l, it WHERE it.k = 15) l JOIN g USING (ft)),
      z AS (SELECT pow(sum(g * u), 2) / (sum(g * g * v) - pow(sum(g * v), 2) / sum(v)) AS chisq FROM t)
    SELECT term, round(chisq, 5) AS chisq, 1 AS df, round({sql_chi2("chisq", 1)}, 5) AS p_value FROM z, (VALUES ('x'), ('GLOBAL')) t(term)""",
)
def cox_zph_uni(spark: SparkSession, sf: str) -> DataFrame:
    frame = survival_frame(spark, sf)
    return rounded(ph_test(frame, cox(frame, "ft", "ot", ["x"]), "ft", "ot"), 5)


@query(
    "fit_summary",
    f"""WITH RECURSIVE {_cox_terms()}, f AS (SELECT b FROM it WHERE k = 15),
      ll AS (SELECT sum(dx / d * b - ln(n0 - a * (d - dx) + (n1 - a * dx) * exp(b))) AS ll,
        sum(-ln(n0 - a * (d - dx) + n1 - a * dx)) AS ll0, sum(dx / d - (n1 - a * dx) / (n0 + n1 - i)) AS u,
        sum((n1 - a * dx) / (n0 + n1 - i) * (1 - (n1 - a * dx) / (n0 + n1 - i))) AS i0 FROM l, f),
      tot AS (SELECT count(*) AS n, sum(ot) AS e, (SELECT info FROM it WHERE k = 15) AS info FROM sf)
    SELECT 'cox' AS model, 'n' AS statistic, CAST(n AS DOUBLE) AS value FROM tot UNION ALL SELECT 'cox', 'events', CAST(e AS DOUBLE) FROM tot
    UNION ALL SELECT 'cox', 'loglik', round(ll, 5) FROM ll UNION ALL SELECT 'cox', 'loglik_null', round(ll0, 5) FROM ll
    UNION ALL SELECT 'cox', 'lr_chisq', round(2 * (ll - ll0), 5) FROM ll UNION ALL SELECT 'cox', 'wald_chisq', round(b * b * info, 5) FROM f, tot
    UNION ALL SELECT 'cox', 'score_chisq', round(u * u / i0, 5) FROM ll UNION ALL SELECT 'cox', 'lr_p', round({sql_chi2("2 * (ll - ll0)", 1)}, 5) FROM ll
    UNION ALL SELECT 'cox', 'wald_p', round({sql_chi2("b * b * info", 1)}, 5) FROM f, tot UNION ALL SELECT 'cox', 'score_p', round({sql_chi2("u * u / i0", 1)}, 5) FROM ll
    UNION ALL SELECT 'logistic', statistic, value FROM (
      SELECT unnest(['n', 'events', 'null_deviance', 'deviance', 'aic', 'loglik']) AS statistic,
        unnest([n, e, round(-2 * l0, 5), round(-2 * l1, 5), round(-2 * l1 + 4, 5), round(l1, 5)]) AS value FROM (
        SELECT sum(n) AS n, sum(s) AS e, sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) AS l1,
          sum(s) * ln(sum(s) / sum(n)) + (sum(n) - sum(s)) * ln(1 - sum(s) / sum(n)) AS l0
        FROM (SELECT x, count(*)::DOUBLE AS n, sum(ot)::DOUBLE AS s FROM sf GROUP BY 1)))""",
)
def fit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Deviances, likelihoods and global tests of a logistic and a Cox model."""
    frame = survival_frame(spark, sf)
    both = fit_overview({"cox": cox(frame, "ft", "ot", ["x"]), "logistic": logistic(frame, "ot", ["x"])})
    shown = ["n", "events", "loglik", "loglik_null", "lr_chisq", "wald_chisq", "score_chisq", "null_deviance", "deviance", "aic"]
    shown += ["lr_p", "wald_p", "score_p"]
    return rounded(both.filter(F.col("statistic").isin(shown)), 5)


SQL_PS = f"""{SQL_SURVIVAL}, p AS (SELECT *, avg(treat) OVER (PARTITION BY x, rich) AS ps, avg(treat) OVER () AS ep FROM sf),
    iw AS (SELECT *, treat * ep / ps + (1 - treat) * (1 - ep) / (1 - ps) AS iptw FROM p)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Propensity score from a saturated model of two binary covariates."""
    frame = survival_frame(spark, sf).withColumn("xr", F.col("x") * F.col("rich"))
    return weights.propensity(frame, "treat", ["x", "rich", "xr"])[0]


@query("ps_saturated", f"WITH {SQL_PS} SELECT id, round(ps, 6) AS ps FROM p")
def ps_saturated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("id", "ps"))


@query("iptw", f"WITH {SQL_PS} SELECT id, round(iptw, 6) AS iptw FROM iw")
def iptw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.iptw(scored(spark, sf), "treat", "ps").select("id", "iptw"))


@query(
    "ps_histogram",
    f"""WITH {SQL_PS} SELECT treat, bin, count(*) AS n, round((bin - 1) * 0.05::DOUBLE, 9) AS bin_lo, round(bin * 0.05::DOUBLE, 9) AS bin_hi
    FROM (SELECT treat, CAST(greatest(ceil(round(ps / 0.05, 9)), 1) AS INT) AS bin FROM p) GROUP BY 1, 2""",
)
def ps_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return describe.histogram(scored(spark, sf), "ps", ["treat"])


@query(
    "weighted_smd_iptw",
    f"""WITH {SQL_PS}, m AS (SELECT treat, sum(iptw * x) / sum(iptw) AS x, sum(iptw * rich) / sum(iptw) AS rich, count(*) AS n FROM iw GROUP BY 1),
    r AS (SELECT 'x' AS variable, a.n AS n_0, b.n AS n_1, a.x AS m0, b.x AS m1 FROM m a, m b WHERE a.treat = 0 AND b.treat = 1 UNION ALL
      SELECT 'rich', a.n, b.n, a.rich, b.rich FROM m a, m b WHERE a.treat = 0 AND b.treat = 1)
    SELECT variable, 'binary' AS kind, n_0, n_1, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(sqrt(m0 * (1 - m0)), 6) AS sd_0,
      round(sqrt(m1 * (1 - m1)), 6) AS sd_1, round(abs(m1 - m0) / sqrt((m0 * (1 - m0) + m1 * (1 - m1)) / 2), 6) AS smd FROM r""",
)
def weighted_smd_iptw(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means agree between the groups when the propensity model is saturated."""
    weighted = weights.iptw(scored(spark, sf), "treat", "ps")
    out = describe.baseline_smd(weighted, "treat", [], ["x", "rich"], "iptw")
    return rounded(out)


def propensity_input(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous and binary covariates for matching."""
    return survival_frame(spark, sf).withColumns(
        {"age": F.round(F.col("balance") / 100), "high": flag(F.col("amount") > 250000)}
    )


def _logistic_sql(source: str, y: str, xs: tuple[str, ...], rounds: int) -> str:
    """Newton steps of a logistic model: lt(k, b0, b1, ..) over the distinct rows lc of ``source``."""
    names, p = ("1", *xs), len(xs) + 1
    state = ", ".join(f"b{j}" for j in range(p))
    eta = " + ".join(f"b{j} * {x}" for j, x in enumerate(names))
    cells = [f"sum(v * {names[j]} * {names[k]}) AS m{j}_{k}" for j in range(p) for k in range(j, p)]
    cells += [f"sum((s - n * mu) * {x}) AS m{j}_{p}" for j, x in enumerate(names)]
    rows = f"""SELECT k, {state}, 0::DOUBLE AS m{p}_{p}, {", ".join(cells)} FROM (SELECT *, n * mu * (1 - mu) AS v FROM (
        SELECT lt.*, lc.*, 1 / (1 + exp(-({eta}))) AS mu FROM lt, lc WHERE k < {rounds})) GROUP BY k, {state}"""
    return f"""lc AS (SELECT {", ".join(xs)}, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS s FROM {source} GROUP BY ALL),
      lt AS (SELECT 0 AS k, {", ".join(f"0::DOUBLE AS b{j}" for j in range(p))} UNION ALL
        SELECT k + 1, {", ".join(f"b{j} + m{j}_{p}" for j in range(p))} FROM ({sql_sweep(p, rows, f"k, {state}")}))"""


# The serial matching rule over s(id, treat, ps, h): highest score first, nearest free control within 0.2 deviations.
SQL_SERIAL = """cal AS (SELECT 0.2::DOUBLE * stddev_samp(ps) AS cal FROM s),
      t AS (SELECT *, row_number() OVER (ORDER BY ps DESC, h, id) AS rn FROM s WHERE treat = 1),
      c AS (SELECT * FROM s WHERE treat = 0),
      it AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS tid, NULL::BIGINT AS cid UNION ALL
        SELECT k + 1, CASE WHEN cid IS NULL THEN used ELSE list_append(used, cid) END, tid, cid FROM (
          SELECT it.k, it.used, t.id AS tid, arg_min(c.id, (abs(c.ps - t.ps), -c.ps, c.h, c.id)) AS cid
          FROM it JOIN t ON t.rn = it.k + 1 CROSS JOIN cal
          LEFT JOIN c ON abs(c.ps - t.ps) <= cal.cal AND NOT list_contains(it.used, c.id) GROUP BY it.k, it.used, t.id)),
      pr AS (SELECT tid, cid FROM it WHERE cid IS NOT NULL)
    SELECT s.id, tid AS pair_id, treat, ps, 1.0::DOUBLE AS weight FROM pr JOIN s ON s.id = pr.tid OR s.id = pr.cid"""


@query(
    "psm_pairs",
    f"""WITH RECURSIVE {SQL_SURVIVAL}, pin AS (SELECT *, round(balance / 100) AS age, CASE WHEN amount > 250000 THEN 1 ELSE 0 END AS high FROM sf),
      {_logistic_sql("pin", "treat", ("x", "high", "age"), 12)},
      s AS (SELECT id, treat, round(1 / (1 + exp(-(b0 + b1 * x + b2 * high + b3 * age))), 8) AS ps, md5(id || ':0') AS h FROM pin, lt WHERE k = 12),
      {SQL_SERIAL}""",
)
def psm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-neighbour pairs within 0.2 standard deviations of the fitted score, taken to eight digits."""
    df = weights.propensity(propensity_input(spark, sf), "treat", ["x", "high", "age"])[0]
    return matching.ps_match(rounded(df, 8, "ps"), "id", "treat", "ps")


@query(
    "psm_given_score",
    f"""WITH RECURSIVE {SQL_SURVIVAL}, s AS (SELECT id, treat, floor((balance + 1000) / 110) / 100 AS ps, md5(id || ':0') AS h FROM sf),
      {SQL_SERIAL}""",
)
def psm_given_score(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-neighbour pairs on a score with many equal values, in segments of 50 scores."""
    score = F.floor((F.col("balance") + 1000) / 110) / 100
    return matching.ps_match(survival_frame(spark, sf).withColumn("ps", score), "id", "treat", "ps", per_segment=50, wave=8)


@query(
    "rate_ratio_gee_independence",
    f"""WITH {SQL_PF}, k AS (SELECT sum(ot) FILTER (exposed = 1) / count(*) FILTER (exposed = 1) AS m1, sum(ot) FILTER (exposed = 0) / count(*) FILTER (exposed = 0) AS m0,
      sum(ot) FILTER (exposed = 1) AS y1, sum(ot) FILTER (exposed = 0) AS y0 FROM pf),
    u AS (SELECT id, sum(CASE WHEN exposed = 1 THEN ot - m1 ELSE 0 END) / any_value(y1) AS e1,
      sum(CASE WHEN exposed = 0 THEN ot - m0 ELSE 0 END) / any_value(y0) AS e0 FROM pf, k GROUP BY 1)
    SELECT {SHOWN} FROM (SELECT '(Intercept)' AS term, ln(m0) AS b, (SELECT sqrt(sum(e0 * e0)) FROM u) AS s FROM k UNION ALL
      SELECT 'exposed', ln(m1 / m0), (SELECT sqrt(sum(pow(e1 - e0, 2))) FROM u) FROM k)""",
)
def rate_ratio_gee_independence(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(poisson_gee(panel_frame(spark, sf), "ot", ["exposed"], "id", corr="independence"))


SQL_GEE = f"""{SQL_PF}, it AS (SELECT 0 AS k, ln(avg(ot)) AS a, 0::DOUBLE AS b, 0::DOUBLE AS rho, 0::DOUBLE AS va, 0::DOUBLE AS vb FROM pf UNION ALL
      SELECT k + 1, a + (b11 * u0 - b01 * u1) / det, b + (b00 * u1 - b01 * u0) / det, crs / (ee / (nn - 2) * (prs - 2)),
        (b11 * b11 * m00 - 2 * b11 * b01 * m01 + b01 * b01 * m11) / (det * det), (b01 * b01 * m00 - 2 * b01 * b00 * m01 + b00 * b00 * m11) / (det * det)
      FROM (SELECT *, b00 * b11 - b01 * b01 AS det FROM (
        SELECT k, a, b, rho, sum(n) AS nn, sum(n * (n - 1) / 2) AS prs, sum(ee) AS ee, sum((e * e - ee) / 2) AS crs, sum(u0) AS u0, sum(u1) AS u1,
          sum((zz00 - c * z0 * z0) / (1 - rho)) AS b00, sum((zz01 - c * z0 * z1) / (1 - rho)) AS b01, sum((zz11 - c * z1 * z1) / (1 - rho)) AS b11,
          sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11
        FROM (SELECT *, (ze0 - c * z0 * e) / (1 - rho) AS u0, (ze1 - c * z1 * e) / (1 - rho) AS u1 FROM (
          SELECT *, rho / (1 + (n - 1) * rho) AS c FROM (
            SELECT k, a, b, rho, id, count(*)::DOUBLE AS n, sum(sqrt(mu)) AS z0, sum(exposed * sqrt(mu)) AS z1, sum((ot - mu) / sqrt(mu)) AS e,
              sum(pow(ot - mu, 2) / mu) AS ee, sum(mu) AS zz00, sum(exposed * mu) AS zz01, sum(exposed * mu) AS zz11,
              sum(ot - mu) AS ze0, sum(exposed * (ot - mu)) AS ze1
            FROM (SELECT it.*, pf.id, pf.ot, pf.exposed, exp(a + b * exposed) AS mu FROM it, pf WHERE k < 25) GROUP BY k, a, b, rho, id)))
        GROUP BY k, a, b, rho)))"""


@query(
    "gee_exchangeable",
    f"""WITH RECURSIVE {SQL_GEE}
    SELECT {SHOWN}, alpha FROM (SELECT '(Intercept)' AS term, a AS b, sqrt(va) AS s, round(rho, 6) AS alpha FROM it WHERE k = 25 UNION ALL
      SELECT 'exposed', b, sqrt(vb), round(rho, 6) FROM it WHERE k = 25)""",
)
def gee_exchangeable(spark: SparkSession, sf: str) -> DataFrame:
    """Poisson rates with exchangeable correlation inside persons."""
    fit = poisson_gee(panel_frame(spark, sf), "ot", ["exposed"], "id")
    return rounded(_coefficients(fit).withColumn("alpha", F.lit(float(fit.stats["alpha"]))))


@query(
    "rate_ratio_exposed",
    f"""WITH RECURSIVE {SQL_GEE} SELECT 'exposed' AS term, round(exp(b), 2) AS ratio, round(exp(b - 1.96 * sqrt(vb)), 2) AS lower,
    round(exp(b + 1.96 * sqrt(vb)), 2) AS upper, round({sql_p("b / sqrt(vb)")}, 4) AS p_value FROM it WHERE k = 25""",
)
def rate_ratio_exposed(spark: SparkSession, sf: str) -> DataFrame:
    """Rate ratio of the exposure with 1.96-limits from the robust standard error."""
    fit = poisson_gee(panel_frame(spark, sf), "ot", ["exposed"], "id")
    return ratio_table(fit, "robust", 1.96, (2, 2, 4)).filter("term = 'exposed'")


def _gee_sql(xs: tuple[str, ...]) -> str:
    """Poisson GEE with exchangeable correlation and any covariates: coefficients b{j}, robust variances v{j}."""
    names, p = ("1", *xs), len(xs) + 1
    js, pairs = range(p), [(j, k) for j in range(p) for k in range(j, p)]
    listed = ", ".join
    state = listed(f"b{j}" for j in js)
    eta = " + ".join(f"b{j} * {x}" for j, x in enumerate(names))
    person = listed(
        [f"sum({x} * sqrt(mu)) AS z{j}, sum({x} * (ot - mu)) AS e{j}" for j, x in enumerate(names)] + [f"sum({names[j]} * {names[k]} * mu) AS y{j}_{k}" for j, k in pairs]
    )
    rows = f"""SELECT k, {state}, rho, sum(n) AS nn, sum(n * (n - 1) / 2) AS prs, sum(ee) AS ee, sum((e * e - ee) / 2) AS crs, 0::DOUBLE AS m{p}_{p},
        {listed(f"sum((y{j}_{k} - c * z{j} * z{k}) / (1 - rho)) AS m{j}_{k}, sum(u{j} * u{k}) AS q{j}_{k}" for j, k in pairs)}, {listed(f"sum(u{j}) AS m{j}_{p}" for j in js)}
      FROM (SELECT *, {listed(f"(e{j} - c * z{j} * e) / (1 - rho) AS u{j}" for j in js)} FROM (SELECT *, rho / (1 + (n - 1) * rho) AS c FROM (
        SELECT k, {state}, rho, id, count(*)::DOUBLE AS n, sum((ot - mu) / sqrt(mu)) AS e, sum(pow(ot - mu, 2) / mu) AS ee, {person}
        FROM (SELECT it.*, pf.id, pf.ot, {listed(f"pf.{x}" for x in xs)}, exp({eta}) AS mu FROM it, pf WHERE k < 25) GROUP BY k, {state}, rho, id)))
      GROUP BY k, {state}, rho"""
    cell = lambda c, j, k: f"{c}{min(j, k)}_{max(j, k)}"
    robust = listed(" + ".join(f"{cell('m', j, a)} * {cell('q', a, b)} * {cell('m', b, j)}" for a in js for b in js) for j in js)
    keep = f"k, {state}, rho, nn, prs, ee, crs, {listed(f'q{j}_{k}' for j, k in pairs)}"
    return f"""{SQL_PF}, it AS (SELECT 0 AS k, ln(avg(ot)) AS b0, {listed(f"0::DOUBLE AS b{j}" for j in js if j)}, 0::DOUBLE AS rho, {listed(f"0::DOUBLE AS v{j}" for j in js)} FROM pf
      UNION ALL SELECT k + 1, {listed(f"b{j} + m{j}_{p}" for j in js)}, crs / (ee / (nn - {p}) * (prs - {p})), {robust} FROM ({sql_sweep(p, rows, keep)}))"""


@query(
    "rate_ratio_table",
    f"""WITH RECURSIVE {_gee_sql(("exposed", "rich"))}, t AS (
      SELECT '(Intercept)' AS term, b0 AS b, sqrt(v0) AS s FROM it WHERE k = 25 UNION ALL SELECT 'exposed', b1, sqrt(v1) FROM it WHERE k = 25
      UNION ALL SELECT 'rich', b2, sqrt(v2) FROM it WHERE k = 25)
    SELECT term, round(exp(b), 2) AS ratio, round(exp(b - 1.96 * s), 2) AS lower, round(exp(b + 1.96 * s), 2) AS upper, round({sql_p("b / s")}, 4) AS p_value FROM t""",
)
def rate_ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rate ratios with 1.96-limits from the robust standard error, rounded to two digits."""
    fit = poisson_gee(panel_frame(spark, sf), "ot", ["exposed", "rich"], "id")
    return ratio_table(fit, "robust", 1.96, (2, 2, 4))


@query("design_comparison")
def design_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Incidence rates and hazard ratios of the crude, matched and weighted designs."""
    frame = propensity_input(spark, sf)
    sets, _ = propensity_study.designs(frame, "id", "treat", ["x", "high", "age"])
    sets = {n: held(d) for n, d in sets.items()}
    w = {"crude": None, "matched": None, "weighted": "iptw"}
    fits = {
        "crude": cox(sets["crude"], "ft", "ot", ["treat", "x", "high", "age"]),
        "matched": cox(sets["matched"], "ft", "ot", ["treat"], strata=["pair_id"]),
        "weighted": cox(sets["weighted"], "ft", "ot", ["treat"], weight="iptw"),
    }
    hazards = describe.compare_designs({n: ratio_table(f).filter("term = 'treat'") for n, f in fits.items()})
    rates = describe.compare_designs(
        {n: describe.incidence(d, "ft", "ot", ["treat"], 100, w[n]) for n, d in sets.items()}
    )
    return union_all(
        hazards.select("design", F.lit("hazard ratio").alias("measure"), "term", F.col("ratio").alias("value")),
        rates.select("design", F.lit("rate").alias("measure"), F.col("treat").cast("string").alias("term"), F.col("rate").alias("value")),
    )


@query(
    "labels_odds",
    """SELECT round(ln(a * d / (b * c)), 6) AS estimate FROM (SELECT count(*) FILTER (toxic = 1 AND quality = 1)::DOUBLE AS a,
    count(*) FILTER (toxic = 1 AND quality = 0)::DOUBLE AS b, count(*) FILTER (toxic = 0 AND quality = 1)::DOUBLE AS c,
    count(*) FILTER (toxic = 0 AND quality = 0)::DOUBLE AS d FROM labels)""",
)
def labels_odds(spark: SparkSession, sf: str) -> DataFrame:
    """Log odds ratio of two given 0/1 labels."""
    fit = logistic(table(spark, sf, "labels", "quality", "toxic"), "quality", ["toxic"])
    return rounded(fit.tidy().filter("term = 'toxic'").select("estimate"))


def _concordance_sql(score: str) -> str:
    return f"""WITH {SQL_SURVIVAL}, c AS (SELECT {score} AS s, ft, ot FROM sf), g AS (SELECT s, ft, ot, count(*) AS n FROM c GROUP BY ALL),
      p AS (SELECT sum(CASE WHEN b.s < a.s THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN b.s > a.s THEN a.n * b.n ELSE 0 END) AS d,
        sum(CASE WHEN b.s = a.s THEN a.n * b.n ELSE 0 END) AS t FROM g a JOIN g b ON b.ft > a.ft OR (b.ft = a.ft AND b.ot = 0) WHERE a.ot = 1)
    SELECT CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant, CAST(t AS BIGINT) AS tied_score,
      round((c + t / 2) / (c + d + t), 6) AS concordance FROM p"""


@query("concordance", _concordance_sql("floor(balance / 50)"))
def concordance(spark: SparkSession, sf: str) -> DataFrame:
    """Concordance of a score with many values and ties."""
    df = survival_frame(spark, sf).withColumn("score", F.floor(F.col("balance") / 50))
    return rounded(survival.concordance(df, "ft", "ot", "score"))


@query(
    "concordance_of_fit",
    f"""{SQL_COX_TWO}, risk AS (SELECT x * b + rich * g AS s, ft, ot FROM sf, it WHERE k = 12), like_rows AS (SELECT s, ft, ot, count(*) AS n FROM risk GROUP BY ALL),
      p AS (SELECT sum(CASE WHEN o.s < a.s THEN a.n * o.n ELSE 0 END) AS con, sum(CASE WHEN o.s > a.s THEN a.n * o.n ELSE 0 END) AS dis,
        sum(CASE WHEN o.s = a.s THEN a.n * o.n ELSE 0 END) AS tie FROM like_rows a JOIN like_rows o ON o.ft > a.ft OR (o.ft = a.ft AND o.ot = 0) WHERE a.ot = 1)
    SELECT CAST(con AS BIGINT) AS concordant, CAST(dis AS BIGINT) AS discordant, CAST(tie AS BIGINT) AS tied_score,
      round((con + tie / 2) / (con + dis + tie), 6) AS concordance FROM p""",
)
def concordance_of_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Concordance of the linear predictor of a fitted Cox model."""
    frame = survival_frame(spark, sf)
    fit = cox(frame, "ft", "ot", ["x", "rich"])
    return rounded(survival.concordance(risk_score(frame, fit), "ft", "ot", "risk"))
