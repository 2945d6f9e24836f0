"""The given star-schema tables in the roles of a claims study.

Person = customer, claim header = order (two code slots), order line = line item, code list = part,
enrolment record = order, supply episode = line item (ship date, quantity days).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.clean import flag
from claimweave.operators import claims, cohort, panel
from claimweave.session import tune
from claimweave.sources.files import read_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the mapped study.
STUDY_END = "2001-08-01"
PANEL_START, PANEL_END = "1998-01-15", "1998-12-31"
LABELS = (("urgent", "^1-"), ("high", "^2-"), ("low", "^5-"), ("filled", "^F$"))
SLOTS = ("c1", "c2")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_columns(spark, f"{sf_dir}/{name}.parquet", list(columns))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim headers: claim key, person, day, two code slots and an amount."""
    return table(
        spark, sf_dir, "orders",
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice",
    ).select(
        F.col("o_orderkey").alias("claim"),
        F.col("o_custkey").alias("id"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderpriority").alias("c1"),
        F.col("o_orderstatus").alias("c2"),
        F.col("o_totalprice").alias("amount"),
    )


SQL_H = """h AS (SELECT o_orderkey AS claim, o_custkey AS id, CAST(o_orderdate AS DATE) AS d,
    o_orderpriority AS c1, o_orderstatus AS c2, o_totalprice AS amount FROM orders)"""


def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's first claim."""
    return cohort.first_record(headers(spark, sf_dir), "id", [("d", "asc"), ("claim", "asc")])


SQL_FIRST = """first_claim AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, claim) AS rn FROM h) WHERE rn = 1)"""


def last_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's last claim day, used as index date."""
    return headers(spark, sf_dir).groupBy("id").agg(F.max("d").alias("index_date"))


SQL_LAST = "last_claim AS (SELECT id, max(d) AS index_date FROM h GROUP BY id)"


def outcomes(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Outcome days: filled urgent claims."""
    filled = headers(spark, sf_dir).filter(F.col("c2") == "F")
    return cohort.outcome_events([(filled, "d", ["c1"])], ids, "id", "^1-")


SQL_OT = "ev AS (SELECT DISTINCT id, d AS ot_date, 1 AS ot FROM h WHERE c2 = 'F' AND c1 LIKE '1-%')"


def survival_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up from the first claim to the first later outcome, with person-level covariates."""
    first = first_claims(spark, sf_dir).select(
        "id", F.col("d").alias("index_date"), flag(F.col("c1").rlike("^[12]-")).alias("x"), F.col("amount")
    )
    later = (
        outcomes(spark, sf_dir)
        .join(first.select("id", "index_date"), "id")
        .filter(F.col("ot_date") > F.col("index_date"))
        .drop("index_date")
    )
    event = cohort.first_record(later, "id", [("ot_date", "asc")])
    people = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        flag(F.col("c_acctbal") > 5000).alias("rich"),
        flag(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("treat"),
        (F.lit(0.5) + F.pmod("c_custkey", F.lit(3)) * 0.75).alias("w"),
    )
    frame = cohort.analytic_frame(first, "id", event, [people], study_end=STUDY_END)
    return frame.filter(F.col("ft") > 0)


SQL_SF = f"""sf AS (SELECT f.id, f.d AS index_date, CASE WHEN f.c1 LIKE '1-%' OR f.c1 LIKE '2-%' THEN 1 ELSE 0 END AS x,
        f.amount, CASE WHEN e.ot_date IS NULL THEN 0 ELSE 1 END AS ot,
        coalesce(e.ot_date, DATE '{STUDY_END}') AS ot_date,
        CAST(coalesce(e.ot_date, DATE '{STUDY_END}') - f.d AS DOUBLE) AS ft,
        c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment,
        CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS rich,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS treat,
        0.5 + (c_custkey % 3) * 0.75::DOUBLE AS w
    FROM first_claim f
    LEFT JOIN (SELECT f.id, min(ev.ot_date) AS ot_date FROM first_claim f JOIN ev ON ev.id = f.id AND ev.ot_date > f.d
               GROUP BY f.id) e ON e.id = f.id
    LEFT JOIN customer ON c_custkey = f.id
    WHERE coalesce(e.ot_date, DATE '{STUDY_END}') > f.d)"""
SQL_SURVIVAL = f"{SQL_H}, {SQL_FIRST}, {SQL_OT}, {SQL_SF}"


def supply_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply intervals per person; small standard parts count as exposure."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_type").select(
        "p_partkey", flag(F.col("p_type").rlike("^S")).alias("exposed")
    )
    owner = headers(spark, sf_dir).select("claim", "id")
    linked = lines.join(owner, lines.l_orderkey == owner.claim).join(parts, lines.l_partkey == parts.p_partkey)
    rows = linked.select("id", F.to_date("l_shipdate").alias("ship"), F.col("l_quantity").alias("days"), "exposed")
    return claims.episodes(rows, "ship", "days")


SQL_EP = """ep AS (SELECT o_custkey AS id, CAST(l_shipdate AS DATE) AS start_date, l_quantity AS days,
        CASE WHEN p_type LIKE 'S%' THEN 1 ELSE 0 END AS exposed,
        CAST(l_shipdate AS DATE) + (CAST(floor(l_quantity - 1) AS INT)) AS end_date
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def panel_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with their first claim inside the panel year."""
    first = headers(spark, sf_dir).filter(F.col("d").between("1998-01-01", PANEL_END))
    return first.groupBy("id").agg(F.min("d").alias("index_date"))


SQL_PC = f"""pc AS (SELECT id, min(d) AS index_date FROM h WHERE d BETWEEN DATE '1998-01-01' AND DATE '{PANEL_END}'
    GROUP BY id)"""
SQL_PANEL = f"""cal AS (SELECT strftime(day, '%Y%m') AS obs_ym, min(CAST(day AS DATE)) AS obs_date_on,
        max(CAST(day AS DATE)) AS obs_date_off
    FROM generate_series(DATE '{PANEL_START}', DATE '{PANEL_END}', INTERVAL 1 DAY) AS g(day) GROUP BY 1),
    panel AS (SELECT id, index_date, obs_ym, obs_date_on, obs_date_off FROM pc, cal WHERE obs_date_off >= index_date)"""
SQL_EXPO = """expo AS (SELECT p.id, p.obs_ym,
        max(CASE WHEN exposed = 1 AND obs_date_on <= end_date AND start_date <= obs_date_off THEN 1 ELSE 0 END) AS exposed
    FROM panel p JOIN ep ON ep.id = p.id GROUP BY 1, 2)"""
SQL_EVN = """evn AS (SELECT p.id, p.obs_ym, count(ot_date) AS ot
    FROM panel p LEFT JOIN ev ON ev.id = p.id AND ot_date BETWEEN obs_date_on AND obs_date_off GROUP BY 1, 2)"""
SQL_PF = f"""{SQL_H}, {SQL_OT}, {SQL_EP}, {SQL_PC}, {SQL_PANEL}, {SQL_EXPO}, {SQL_EVN},
    pf AS (SELECT p.*, e.exposed, v.ot, c.rich FROM panel p JOIN expo e USING (id, obs_ym) JOIN evn v USING (id, obs_ym)
    JOIN (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS rich FROM customer) c USING (id))"""


def panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-month panel with exposure, event counts and one covariate."""
    people = panel_cohort(spark, sf_dir)
    months = panel.person_periods(people, "id", "index_date", PANEL_START, PANEL_END)
    exposed = panel.period_exposure(months, supply_episodes(spark, sf_dir), "id", "exposed", PANEL_START, PANEL_END)
    counted = panel.period_events(months, outcomes(spark, sf_dir), "id", PANEL_START, PANEL_END)
    covariates = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(
        F.col("c_custkey").alias("id"), flag(F.col("c_acctbal") > 5000).alias("rich")
    )
    return panel.assemble_panel(months, covariates, exposed, counted, "id")


def sql_erfc(x: str) -> str:
    """SQL text of the complementary error function at x >= 0, by Simpson sums up to x + 10."""
    parts = f"CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({x} + i * 0.0025::DOUBLE, 2))"
    return f"(list_sum(list_transform(range(0, 4001), lambda i: {parts})) * {0.0025 / 3 * 1.1283791670955126!r}::DOUBLE)"


def sql_p(z: str) -> str:
    """SQL text of the two-sided normal tail."""
    return sql_erfc(f"abs({z}) / sqrt(2.0::DOUBLE)")


def sql_chi2(x: str, df: int) -> str:
    """SQL text of the chi-square tail for whole degrees of freedom."""
    if df % 2 == 0:
        return f"(exp(-({x}) / 2) * ({' + '.join(f'pow(({x}) / 2, {k}) / {math.factorial(k)}' for k in range(df // 2))}))"
    terms = [f"exp(-({x}) / 2) * pow(({x}) / 2, {k + 0.5}) / {math.gamma(k + 1.5)!r}::DOUBLE" for k in range((df - 1) // 2)]
    return "(" + " + ".join([sql_erfc(f"sqrt(({x}) / 2)"), *terms]) + ")"


def sql_sweep(p: int, rows: str, keep: str) -> str:
    """SQL text that solves symmetric systems: ``rows`` has m{i}_{j} for i <= j <= p, of which column p is the right side.

    After sweeping the first p pivots, m{i}_{p} is the solution, -m{i}_{j} the inverse, -m{p}_{p} the quadratic form.
    """
    name = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    for k in range(p):
        cells = []
        for i in range(p + 1):
            for j in range(i, p + 1):
                if i == j == k:
                    cell = f"-1 / {name(k, k)}"
                elif k in (i, j):
                    cell = f"{name(i, j)} / {name(k, k)}"
                else:
                    cell = f"{name(i, j)} - {name(i, k)} * {name(k, j)} / {name(k, k)}"
                cells.append(f"{cell} AS {name(i, j)}")
        rows = f"SELECT {keep}, {', '.join(cells)} FROM ({rows})"
    return rows


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round double columns (all by default) so that results compare across engines."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
