"""Registered queries: index dates, look-back, outcomes, frames, panels and matching designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions import clean
from claimweave.operators import cohort, describe, history, matching, panel
from claimweave.plans.driver_tables import (
    LABELS, PANEL_END, PANEL_START, SLOTS, SQL_EP, SQL_EVN, SQL_EXPO, SQL_FIRST, SQL_H, SQL_LAST, SQL_OT, SQL_PANEL,
    SQL_PC, SQL_PF, SQL_SURVIVAL, STUDY_END, headers, last_claims, outcomes, panel_cohort,
    panel_frame, query, rounded, supply_episodes, survival_frame, table,
)


@query(
    "asof_latest_before_index",
    f"""WITH {SQL_H}, {SQL_LAST} SELECT id, d, claim, amount, index_date FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, claim) AS rn FROM h JOIN last_claim USING (id)
    WHERE d < index_date) WHERE rn = 1""",
)
def asof_latest_before_index(spark: SparkSession, sf: str) -> DataFrame:
    records = headers(spark, sf).select("id", "d", "claim", "amount")
    return cohort.latest_before(records, last_claims(spark, sf), "id", "d", "index_date", [("claim", "asc")])


@query(
    "demographics_at_index",
    f"""WITH {SQL_H}, {SQL_LAST}, r AS (SELECT id, index_date, amount AS amt, claim % 3 AS sex, 1940 + claim % 50 AS birth,
      row_number() OVER (PARTITION BY id ORDER BY d DESC, claim) AS rn FROM h JOIN last_claim USING (id) WHERE d < index_date),
    c AS (SELECT id, CAST(sex AS VARCHAR) AS id_s, CAST(birth AS DOUBLE) AS id_birth_y, amt AS id1_amt, CASE WHEN sex = 1 THEN 1 ELSE 0 END AS male,
      CASE WHEN sex = 2 THEN 1 ELSE 0 END AS female, CAST(year(index_date) - birth AS DOUBLE) AS age,
      CASE WHEN amt < 0 OR amt > 400000 THEN NULL WHEN amt <= 100000 THEN 1 WHEN amt <= 200000 THEN 2 ELSE 3 END AS gp
      FROM r WHERE rn = 1 AND sex IN (1, 2) AND birth % 10 <> 0)
    SELECT id, id_s, id_birth_y, id1_amt, male, female, age, gp AS ins_amt_gp, CAST(gp = 1 AS INT) AS ins_amt_gp_1,
    CAST(gp = 2 AS INT) AS ins_amt_gp_2, CAST(gp = 3 AS INT) AS ins_amt_gp_3 FROM c""",
)
def demographics_at_index(spark: SparkSession, sf: str) -> DataFrame:
    """Covariates of the latest record before the index day, from text columns with unreadable birth years."""
    birth = 1940 + F.col("claim") % 50
    records = headers(spark, sf).select(
        "id", "d", "claim", (F.col("claim") % 3).cast("string").alias("id_s"),
        F.when(birth % 10 == 0, F.lit("19xx")).otherwise(birth.cast("string")).alias("id_birth_y"),
        F.col("amount").cast("string").alias("id1_amt"),
    )
    latest = cohort.latest_before(records, last_claims(spark, sf), "id", "d", "index_date", [("claim", "asc")])
    return cohort.demographics(latest, "index_date", [0, 100000, 200000, 400000]).drop("d", "claim", "index_date")


@query(
    "lookback_records",
    f"""WITH {SQL_H}, {SQL_LAST} SELECT id, claim, d, index_date FROM h JOIN last_claim USING (id)
    WHERE index_date - 365 <= d AND d < index_date""",
)
def lookback_records(spark: SparkSession, sf: str) -> DataFrame:
    records = headers(spark, sf).select("id", "claim", "d")
    return cohort.records_in_window(records, last_claims(spark, sf), "id", "d", "index_date", 365)


def _history(spark: SparkSession, sf: str, dedupe: str) -> DataFrame:
    claims = headers(spark, sf)
    sources = [(claims.filter("c2 <> 'F'"), "d", SLOTS, 1), (claims.filter("c2 = 'F'"), "d", SLOTS, 2)]
    labels = (("early", "^[12]-"), *LABELS[2:])
    return history.history(sources, last_claims(spark, sf), "id", "index_date", labels, 400, dedupe, prefix="pre_")


def _history_sql(unit: str) -> str:
    return f"""WITH {SQL_H}, {SQL_LAST}, l AS (
      SELECT id, d, c1 AS code, CASE WHEN c2 = 'F' THEN 2 ELSE 1 END AS weight FROM h UNION ALL
      SELECT id, d, c2, CASE WHEN c2 = 'F' THEN 2 ELSE 1 END FROM h),
    x AS (SELECT *, CASE WHEN code = 'F' THEN 'filled' WHEN code LIKE '5-%' THEN 'low'
      WHEN code LIKE '1-%' OR code LIKE '2-%' THEN 'early' END AS dx FROM l JOIN last_claim USING (id)
      WHERE d >= index_date - 400 AND d < index_date),
    s AS (SELECT id, dx, sum(weight) AS weight FROM (SELECT id, dx, d, {unit}, max(weight) AS weight FROM x
      WHERE dx IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)
    SELECT id, max(CASE WHEN dx = 'early' THEN 1 ELSE 0 END) AS pre_early, max(CASE WHEN dx = 'low' THEN 1 ELSE 0 END) AS pre_low,
    max(CASE WHEN dx = 'filled' THEN 1 ELSE 0 END) AS pre_filled FROM s WHERE weight >= 2 GROUP BY id"""


@query("lookback_history_dx", _history_sql("1 AS unit"))
def lookback_history_dx(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, "dx")


@query("lookback_history_code", _history_sql("code AS unit"))
def lookback_history_code(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, "code")


@query("outcome_every", f"WITH {SQL_H}, {SQL_OT} SELECT * FROM ev WHERE id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def outcome_every(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer", "c_custkey", "c_nationkey").filter("c_nationkey < 20")
    return outcomes(spark, sf, ids.select(F.col("c_custkey").alias("id")))


@query("outcome_first", f"WITH {SQL_H}, {SQL_OT} SELECT id, min(ot_date) AS ot_date, 1 AS ot FROM ev GROUP BY id")
def outcome_first(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.first_record(outcomes(spark, sf), "id", [("ot_date", "asc")])


@query("episodes", f"WITH {SQL_EP} SELECT id, start_date, end_date, days, exposed, count(*) AS n FROM ep GROUP BY ALL")
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return describe.frequency(supply_episodes(spark, sf), ["id", "start_date", "end_date", "days", "exposed"])


@query(
    "index_date",
    f"""WITH {SQL_EP} SELECT id, start_date AS index_date, exposed FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY start_date, days, exposed) AS rn FROM ep) WHERE rn = 1""",
)
def index_date(spark: SparkSession, sf: str) -> DataFrame:
    order = [("start_date", "asc"), ("days", "asc"), ("exposed", "asc")]
    first = cohort.first_record(supply_episodes(spark, sf), "id", order)
    return first.select("id", F.col("start_date").alias("index_date"), "exposed")


@query(
    "censor_fill",
    f"""WITH {SQL_H}, {SQL_OT} SELECT c_custkey AS id, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS ot,
    coalesce(t, DATE '{STUDY_END}') AS ot_date FROM customer LEFT JOIN (
    SELECT id, min(ot_date) AS t FROM ev GROUP BY id) e ON e.id = c_custkey""",
)
def censor_fill(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("id"))
    first = cohort.first_record(outcomes(spark, sf), "id", [("ot_date", "asc")])
    return clean.censor(people.join(first, "id", "left"), "ot", "ot_date", STUDY_END)


@query(
    "survival_frame",
    f"WITH {SQL_SURVIVAL} SELECT id, index_date, x, ot, ot_date, ft, nation, rich, treat FROM sf",
)
def survival_frame_query(spark: SparkSession, sf: str) -> DataFrame:
    return survival_frame(spark, sf).select("id", "index_date", "x", "ot", "ot_date", "ft", "nation", "rich", "treat")


@query(
    "frame_zero_fill",
    f"""WITH {SQL_H}, {SQL_LAST}, hx AS ({_history_sql("1 AS unit")}) SELECT l.id, index_date, coalesce(pre_early, 0) AS pre_early,
    coalesce(pre_low, 0) AS pre_low, coalesce(pre_filled, 0) AS pre_filled FROM last_claim l LEFT JOIN hx ON hx.id = l.id""",
)
def frame_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.analytic_frame(
        last_claims(spark, sf), "id", tables=[_history(spark, sf, "dx")], fill=["pre_early", "pre_low", "pre_filled"]
    )


def _criteria():
    return [
        ("index from April on", F.month("index_date") >= 4),
        ("positive balance", F.when(F.col("balance") != 0, F.col("balance")) > 0),
        ("near nation", F.col("nation").isin(*range(15))),
    ]


SQL_CRITERIA = ("month(index_date) >= 4", "balance > 0", "nation < 15")


@query(
    "attrition",
    f"""WITH {SQL_SURVIVAL}, k AS (SELECT {SQL_CRITERIA[0]} AS a, {SQL_CRITERIA[1]} AS b, {SQL_CRITERIA[2]} AS c FROM sf),
    n AS (SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3 FROM k)
    SELECT 0 AS step, 'all' AS criterion, n0 AS n, 0::BIGINT AS n_dropped FROM n UNION ALL
    SELECT 1, 'index from April on', n1, n0 - n1 FROM n UNION ALL SELECT 2, 'positive balance', n2, n1 - n2 FROM n
    UNION ALL SELECT 3, 'near nation', n3, n2 - n3 FROM n""",
)
def attrition(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.select_cohort(survival_frame(spark, sf), _criteria())[1]


@query("select_cohort", f"WITH {SQL_SURVIVAL} SELECT id, index_date, ft, ot FROM sf WHERE {' AND '.join(SQL_CRITERIA)}")
def select_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.select_cohort(survival_frame(spark, sf), _criteria())[0].select("id", "index_date", "ft", "ot")


@query("person_month_panel", f"WITH {SQL_H}, {SQL_PC}, {SQL_PANEL} SELECT * FROM panel")
def person_month_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.person_periods(panel_cohort(spark, sf), "id", "index_date", PANEL_START, PANEL_END)


@query(
    "panel_exposure",
    f"""WITH {SQL_H}, {SQL_EP}, {SQL_PC}, {SQL_PANEL}, {SQL_EXPO}
    SELECT id, index_date, obs_ym, obs_date_on, obs_date_off, exposed FROM panel JOIN expo USING (id, obs_ym)""",
)
def panel_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return panel.period_exposure(
        person_month_panel(spark, sf), supply_episodes(spark, sf), "id", "exposed", PANEL_START, PANEL_END
    )


@query(
    "panel_events",
    f"""WITH {SQL_H}, {SQL_OT}, {SQL_PC}, {SQL_PANEL}, {SQL_EVN}
    SELECT id, index_date, obs_ym, obs_date_on, obs_date_off, ot FROM panel JOIN evn USING (id, obs_ym)""",
)
def panel_events(spark: SparkSession, sf: str) -> DataFrame:
    return panel.period_events(person_month_panel(spark, sf), outcomes(spark, sf), "id", PANEL_START, PANEL_END)


@query(
    "panel_frame",
    f"WITH {SQL_PF} SELECT id, index_date, obs_ym, obs_date_on, obs_date_off, exposed, ot, rich FROM pf",
)
def panel_frame_query(spark: SparkSession, sf: str) -> DataFrame:
    return panel_frame(spark, sf)


SQL_MATCH = f"""{SQL_SURVIVAL}, r AS (SELECT id, ot, rich, treat, x,
      row_number() OVER (PARTITION BY rich, treat, ot ORDER BY md5(id || ':407'), id) AS q,
      count(*) FILTER (ot = 1) OVER (PARTITION BY rich, treat) AS n1, count(*) FILTER (ot = 0) OVER (PARTITION BY rich, treat) AS n0 FROM sf),
    t AS (SELECT *, CASE WHEN n0 >= 2 * n1 THEN n1 ELSE n0 // 2 END AS sets FROM r),
    matched AS (SELECT id, ot, rich, treat, x, rich || '-' || treat || '-' || CAST(CASE WHEN ot = 1 THEN q ELSE ceil(q / 2.0) END AS BIGINT) AS gg
      FROM t WHERE (ot = 1 AND q <= sets) OR (ot = 0 AND q <= sets * 2))"""


def matched_sets(spark: SparkSession, sf: str) -> DataFrame:
    frame = survival_frame(spark, sf).select("id", "ot", "rich", "treat", "x")
    return matching.frequency_match(frame, "ot", ["rich", "treat"], 2, 407, "id")


@query("freq_match", f"WITH {SQL_MATCH} SELECT * FROM matched")
def freq_match(spark: SparkSession, sf: str) -> DataFrame:
    return matched_sets(spark, sf)


@query(
    "balance_before_after",
    f"""WITH {SQL_MATCH} SELECT phase, ot, count(*) AS n, round(avg(rich) * 100, 6) AS rich, round(avg(treat) * 100, 6) AS treat,
    round(avg(x) * 100, 6) AS x FROM (SELECT 'before' AS phase, ot, rich, treat, x FROM sf UNION ALL
    SELECT 'after', ot, rich, treat, x FROM matched) GROUP BY 1, 2""",
)
def balance_before_after(spark: SparkSession, sf: str) -> DataFrame:
    before = survival_frame(spark, sf)
    return rounded(describe.balance(before, matched_sets(spark, sf), "ot", ["rich", "treat", "x"]))
