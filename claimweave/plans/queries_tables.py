"""Registered queries: sources, projection, cleaning, filters, joins, aggregates, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions import clean
from claimweave.operators import claims, codes, cohort, describe, history, ordered
from claimweave.plans.driver_tables import (
    LABELS, SLOTS, SQL_FIRST, SQL_H, SQL_LAST, first_claims, headers, last_claims, query, rounded, table,
)
from claimweave.session import stage_path
from claimweave.sources import calendar, files


@query("scan_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 250000")
def scan_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").filter(F.col("o_totalprice") >= 250000)


@query(
    "delimited_text",
    "SELECT CAST(p_partkey AS BIGINT) AS code, p_name || ', ' || p_brand AS name, p_type AS class FROM part",
)
def delimited_text(spark: SparkSession, sf: str) -> DataFrame:
    """Write part rows as text with an explanatory line and a header, and read them back by content."""
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    quoted = F.concat(F.lit('"'), "p_name", F.lit(", "), "p_brand", F.lit('"'))
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, "p_type")
    texts = F.array(F.lit("List of parts, all years"), F.lit("code,name,class"), row)
    lines = part.select(F.explode(texts).alias("value"))
    return files.parse_lines(lines, "code bigint, name string, class string", "code,name,class", ["List of parts, all years"])


@query(
    "csv_with_header",
    "SELECT CAST(p_partkey AS BIGINT) AS code, p_name || ', ' || p_brand AS name, p_type AS class, p_retailprice AS price FROM part",
)
def csv_with_header(spark: SparkSession, sf: str) -> DataFrame:
    """Store parts as delimited files with a header each, with separators inside values, and read them back."""
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    path = stage_path(spark, "parts_csv")
    part.select(
        F.col("p_partkey").alias("code"), F.concat("p_name", F.lit(", "), "p_brand").alias("name"), F.col("p_type").alias("class"), F.col("p_retailprice").alias("price")
    ).write.csv(path, header=True)
    return files.read_delimited(spark, path, "code bigint, name string, class string, price double")


@query("csv_after_preamble", "SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def csv_after_preamble(spark: SparkSession, sf: str) -> DataFrame:
    """Store text files that begin with explanatory lines and a header, and read the rows below these."""
    nation = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    top = ["Nations and their regions", "Source: code list, all years", "code,name,region"]
    rows = nation.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    lines = spark.createDataFrame([(line,) for line in top], "value string").coalesce(1).unionByName(rows)
    path = stage_path(spark, "nations_text")
    lines.write.text(path)
    return files.read_delimited_with_preamble(spark, path, "code bigint, name string, region bigint", top[2], top[:2])


@query(
    "stage_roundtrip",
    "SELECT o_custkey AS id, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1",
)
def stage_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    per_person = headers(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_date"))
    return files.stage(per_person, "per_person")


@query(
    "calendar_months",
    """SELECT strftime(day, '%Y%m') AS obs_ym, min(CAST(day AS DATE)) AS obs_date_on, max(CAST(day AS DATE)) AS obs_date_off
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS day FROM orders)
    GROUP BY 1""",
)
def calendar_months(spark: SparkSession, sf: str) -> DataFrame:
    bounds = headers(spark, sf).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return calendar.months_of(calendar.days_between(bounds, "a", "b"))


@query(
    "project_rename_derive",
    """SELECT c_custkey AS id, c_acctbal AS pre_balance, c_nationkey AS pre_nation, 1 AS win_key,
    CASE WHEN c_acctbal < 0 THEN 2 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS grp FROM customer""",
)
def project_rename_derive(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.rename(
        table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", "c_name"),
        c_custkey="id", c_acctbal="pre_balance", c_nationkey="pre_nation",
    )
    rules = [(F.col("c_mktsegment") == "BUILDING", 1), (F.col("pre_balance") < 0, 2)]
    df = df.withColumn("win_key", F.lit(1)).withColumn("grp", clean.overwrite(0, *rules)).drop("c_name", "c_mktsegment")
    return df.select("id", *clean.columns_like(df, "^pre_"), "win_key", "grp")


@query(
    "parse_dates_numbers",
    """SELECT o_orderkey AS claim,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS m,
    CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) / 4 END AS v
    FROM orders""",
)
def parse_dates_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in three layouts, months and numbers as text, with unreadable ones mixed in."""
    k = F.col("claim")
    text = headers(spark, sf).select(
        "claim",
        F.when(k % 7 == 0, F.lit("201402XX"))
        .when(k % 5 == 0, F.date_format("d", "yyyy-MM-dd"))
        .when(k % 3 == 0, F.date_format("d", "yyyy/MM/dd"))
        .otherwise(F.date_format("d", "yyyyMMdd")).alias("d"),
        F.when(k % 7 == 0, F.lit("2014XX")).otherwise(F.date_format("d", "yyyyMM")).alias("m"),
        F.when(k % 11 == 0, F.lit("12d")).when(k % 13 == 0, F.lit(" ")).otherwise((k / 4).cast("string")).alias("v"),
    )
    return text.select(
        "claim", clean.parse_date("d").alias("d"), clean.parse_month("m").alias("m"), clean.parse_number("v").alias("v")
    )


@query(
    "zero_fill",
    """SELECT c_custkey AS id, coalesce(n_urgent, 0) AS n_urgent, coalesce(n_filled, 0) AS n_filled FROM customer
    LEFT JOIN (SELECT o_custkey, CAST(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS BIGINT) AS n_urgent,
        CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS n_filled
        FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey""",
)
def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Left join of person-level counts, missing ones set to 0."""
    people = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("id"))
    counts = headers(spark, sf).filter(F.col("amount") > 300000).groupBy("id").agg(
        F.count_if(F.col("c1") == "1-URGENT").alias("n_urgent"), F.count_if(F.col("c2") == "F").alias("n_filled")
    )
    return cohort.analytic_frame(people, "id", tables=[counts], fill=["n_urgent", "n_filled"])


@query(
    "factor_levels",
    """SELECT CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS level,
    count(*) AS n FROM orders GROUP BY 1""",
)
def factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    level = clean.level_index("c1", ["5-LOW", "3-MEDIUM", "1-URGENT"]).alias("level")
    return describe.frequency(headers(spark, sf).select(level), "level", keep_null=True)


@query(
    "brackets_dummies",
    """SELECT id, gp, CAST(gp = 1 AS INT) AS gp_1, CAST(gp = 2 AS INT) AS gp_2, CAST(gp = 3 AS INT) AS gp_3 FROM (
    SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN NULL WHEN c_acctbal <= 2500 THEN 1
    WHEN c_acctbal <= 5000 THEN 2 ELSE 3 END AS gp FROM customer)""",
)
def brackets_dummies(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    gp = clean.bracket("c_acctbal", [0, 2500, 5000, 9000], [1, 2, 3])
    return clean.dummies(df.select(F.col("c_custkey").alias("id"), gp.alias("gp")), "gp", [1, 2, 3])


@query(
    "code_flags",
    f"""WITH {SQL_H} SELECT claim, CASE WHEN c1 LIKE '1-%' OR c1 LIKE '2-%' THEN 1 ELSE 0 END AS early,
    CASE WHEN c2 LIKE 'F%' THEN 1 ELSE 0 END AS filled,
    CASE WHEN c1 LIKE '5-%' OR c2 LIKE 'P%' THEN 1 ELSE 0 END AS slow FROM h""",
)
def code_flags(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"early": ("^[12]-", ["c1"]), "filled": ("^F", ["c2"]), "slow": ("^(5-|P)", SLOTS)}
    return codes.flag_codes(headers(spark, sf), spec).select("claim", *spec)


@query(
    "order_flags",
    """SELECT l_orderkey AS claim, max(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) AS returned,
    max(CASE WHEN l_linenumber IN (6, 7) THEN 1 ELSE 0 END) AS late FROM lineitem GROUP BY 1""",
)
def order_flags(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber")
    lines = codes.flag_orders(lines.withColumnRenamed("l_orderkey", "claim"), "l_returnflag", {"returned": ["A", "R"]})
    lines = codes.flag_orders(lines, "l_linenumber", {"late": [6, 7]})
    return claims.claim_flags(lines, ["claim"], ["returned", "late"])


@query(
    "row_filters",
    f"""WITH {SQL_H} SELECT claim, d, c1, amount FROM h
    WHERE month(d) >= 4 AND c2 IN ('F', 'P') AND amount IS NOT NULL AND (amount > 400000 OR c1 = '1-URGENT')""",
)
def row_filters(spark: SparkSession, sf: str) -> DataFrame:
    keep = (F.month("d") >= 4) & clean.member("c2", ["F", "P"]) & F.col("amount").isNotNull()
    wanted = (F.col("amount") > 400000) | (F.col("c1") == "1-URGENT")
    return headers(spark, sf).filter(keep & wanted).select("claim", "d", "c1", "amount")


@query(
    "washout_filter",
    f"""WITH {SQL_H}, {SQL_FIRST}, {SQL_LAST} SELECT id, f.d, index_date FROM first_claim f JOIN last_claim USING (id)
    WHERE NOT (index_date <= f.d)""",
)
def washout_filter(spark: SparkSession, sf: str) -> DataFrame:
    both = first_claims(spark, sf).select("id", "d").join(last_claims(spark, sf), "id")
    return both.filter(~(F.col("index_date") <= F.col("d")))


@query(
    "timeline_kth",
    f"""WITH {SQL_H} SELECT id, claim, d, c1 FROM h WHERE id = (
    SELECT DISTINCT id FROM h WHERE c1 = '1-URGENT' AND c2 = 'F' ORDER BY id LIMIT 1 OFFSET 4)""",
)
def timeline_kth(spark: SparkSession, sf: str) -> DataFrame:
    who = (F.col("c1") == "1-URGENT") & (F.col("c2") == "F")
    shown = cohort.timeline_of_kth(headers(spark, sf), "id", who, 5, [("d", "asc"), ("claim", "asc")])
    return shown.select("id", "claim", "d", "c1")


@query(
    "codelist_join",
    """SELECT p_type AS class, std, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN (
    SELECT DISTINCT p_partkey, p_type, CASE WHEN p_type LIKE 'STANDARD%' THEN 1 ELSE 0 END AS std FROM part
    WHERE p_type LIKE 'S%') ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def codelist_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part", "p_partkey", "p_type")
    listed = codes.code_list(parts, "p_partkey", "p_type", "^S", {"std": "^STANDARD"})
    lines = table(spark, sf, "lineitem", "l_partkey", "l_quantity").withColumnRenamed("l_partkey", "p_partkey")
    return lines.join(listed, "p_partkey").groupBy(F.col("p_type").alias("class"), "std").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "link_claims",
    f"""WITH {SQL_H} SELECT claim, id, count(*) AS n_lines, sum(l_quantity) AS quantity
    FROM h JOIN lineitem ON l_orderkey = claim GROUP BY 1, 2""",
)
def link_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Headers with their line totals; claims without lines drop out."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("claim")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")
    )
    return claims.link_claims(headers(spark, sf).select("claim", "id"), lines, ["claim"])


@query(
    "composite_key_join",
    """SELECT l_suppkey, l_partkey, ship, n_a, n_r FROM
    (SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS ship, count(*) AS n_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3)
    JOIN (SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS ship, count(*) AS n_r FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2, 3)
    USING (l_suppkey, l_partkey, ship)""",
)
def composite_key_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")
    key = ["l_suppkey", "l_partkey", "ship"]
    lines = lines.withColumn("ship", F.to_date("l_shipdate"))
    part = lambda f, n: lines.filter(F.col("l_returnflag") == f).groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    return claims.link_claims(part("A", "n_a"), part("N", "n_r"), key)


@query(
    "restrict_to_cohort",
    f"""WITH {SQL_H} SELECT id, claim, d FROM h
    WHERE id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')""",
)
def restrict_to_cohort(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'FURNITURE'")
    return cohort.restrict_to(headers(spark, sf), ids.select(F.col("c_custkey").alias("id")), "id").select("id", "claim", "d")


SQL_STAYS = """bills AS (SELECT id, date_trunc('quarter', d)::DATE AS in_date, c1 AS hosp, strftime(d, '%Y%m') AS ym,
        max(floor(amount / 10000)) AS e_day, max(CASE WHEN c2 = 'F' THEN 3.0::DOUBLE ELSE 0 END) AS s_day,
        max(CASE WHEN c2 = 'F' THEN 1 ELSE 0 END) AS filled, max(returned) AS returned
    FROM h JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
                 FROM lineitem GROUP BY 1) ON l_orderkey = claim GROUP BY 1, 2, 3, 4),
    stays AS (SELECT id, in_date, hosp, sum(e_day) AS e_day, sum(s_day) AS s_day, max(filled) AS filled,
        max(returned) AS returned, sum(e_day) + sum(s_day) AS bed_day FROM bills GROUP BY 1, 2, 3)"""


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """Stays: claims of a person, quarter and priority, with line flags and added-up days."""
    heads = codes.flag_codes(headers(spark, sf), {"filled": ("^F", ["c2"])}).select(
        "claim", "id", F.trunc("d", "quarter").alias("in_date"), F.col("c1").alias("hosp"),
        F.date_format("d", "yyyyMM").alias("ym"), F.floor(F.col("amount") / 10000).cast("double").alias("e_day"),
        F.when(F.col("filled") == 1, 3.0).otherwise(0.0).alias("s_day"), "filled",
    )
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag").withColumnRenamed("l_orderkey", "claim")
    lines = claims.claim_flags(codes.flag_orders(lines, "l_returnflag", {"returned": ["R"]}), ["claim"], ["returned"])
    outer = ["id", "in_date", "hosp"]
    return claims.rollup(
        claims.link_claims(heads, lines, ["claim"]), [*outer, "ym"], outer, ["e_day", "s_day"], ["filled", "returned"]
    ).withColumn("bed_day", F.col("e_day") + F.col("s_day"))


@query("header_detail_rollup", f"WITH {SQL_H}, {SQL_STAYS} SELECT * FROM stays")
def header_detail_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return stays(spark, sf)


@query(
    "first_stay",
    f"""WITH {SQL_H}, {SQL_STAYS} SELECT * EXCLUDE (rn) FROM (SELECT *,
    row_number() OVER (PARTITION BY id ORDER BY in_date, bed_day DESC, hosp) AS rn FROM stays
    WHERE filled = 1 OR returned = 1) WHERE rn = 1""",
)
def first_stay(spark: SparkSession, sf: str) -> DataFrame:
    wanted = stays(spark, sf).filter((F.col("filled") == 1) | (F.col("returned") == 1))
    return cohort.first_record(wanted, "id", [("in_date", "asc"), ("bed_day", "desc"), ("hosp", "asc")])


@query(
    "channel_union_rollup",
    """SELECT supp, ship, CASE WHEN count(days) = count(*) THEN sum(days) END AS days, max(late) AS late FROM (
      SELECT l_suppkey AS supp, CAST(l_shipdate AS DATE) AS ship, CASE WHEN l_quantity < 49 THEN l_quantity END AS days,
      CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END AS late FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1, 2""",
)
def channel_union_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels stacked and merged per visit; one unknown quantity makes the visit's days unknown."""
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_linenumber", "l_returnflag").select(
        F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("ship"),
        F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("days"),
        clean.flag(F.col("l_linenumber") >= 6).alias("late"), "l_returnflag",
    )
    channel = lambda f: claims.merge_channels(
        [lines.filter(F.col("l_returnflag") == f)], ["supp", "ship"], ["days"], ["late"]
    )
    return claims.merge_channels([channel("A"), channel("R")], ["supp", "ship"], ["days"], ["late"])


@query(
    "null_policies",
    """SELECT l_suppkey AS supp, CASE WHEN count(q) = count(*) THEN max(q) END AS max_p, max(q) AS max_s,
    CASE WHEN count(q) = count(*) THEN sum(q) END AS sum_p, coalesce(sum(q), 0) AS sum_s
    FROM (SELECT l_suppkey, CASE WHEN l_quantity < 50 OR l_suppkey % 2 = 0 THEN l_quantity END AS q FROM lineitem) GROUP BY 1""",
)
def null_policies(spark: SparkSession, sf: str) -> DataFrame:
    keep = (F.col("l_quantity") < 50) | (F.col("l_suppkey") % 2 == 0)
    df = table(spark, sf, "lineitem", "l_suppkey", "l_quantity").select(
        F.col("l_suppkey").alias("supp"), F.when(keep, F.col("l_quantity")).alias("q")
    )
    return df.groupBy("supp").agg(
        claims.group_max("q", "propagate").alias("max_p"), claims.group_max("q").alias("max_s"),
        claims.group_sum("q", "propagate").alias("sum_p"), claims.group_sum("q").alias("sum_s"),
    )


@query("distinct_rows", "SELECT DISTINCT o_custkey AS id, o_orderpriority AS c1 FROM orders")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return headers(spark, sf).select("id", "c1").distinct()


@query(
    "heaviest_then_sum",
    f"""WITH {SQL_H} SELECT id, c1, CAST(sum(weight) AS BIGINT) AS weight FROM (
    SELECT id, d, c1, max(CASE WHEN c2 = 'F' THEN 2 ELSE 1 END) AS weight FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def heaviest_then_sum(spark: SparkSession, sf: str) -> DataFrame:
    weighted = headers(spark, sf).withColumn("weight", clean.overwrite(1, (F.col("c2") == "F", 2)))
    daily = weighted.groupBy("id", "d", "c1").agg(F.max("weight").alias("weight"))
    return daily.groupBy("id", "c1").agg(F.sum("weight").alias("weight"))


@query(
    "global_mean",
    """SELECT c_custkey AS id, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer""",
)
def global_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    mean = df.agg(F.avg("c_acctbal").alias("m")).scalar()
    return df.select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") - mean, 4).alias("above"))


@query(
    "group_proportions",
    """SELECT c_mktsegment AS segment, count(*) AS n, round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END) * 100, 6) AS rich,
    round(avg(CASE WHEN c_nationkey < 10 THEN 1.0 ELSE 0 END) * 100, 6) AS near FROM customer GROUP BY 1""",
)
def group_proportions(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer", "c_mktsegment", "c_acctbal", "c_nationkey").select(
        F.col("c_mktsegment").alias("segment"), clean.flag(F.col("c_acctbal") > 5000).alias("rich"),
        clean.flag(F.col("c_nationkey") < 10).alias("near"),
    )
    return rounded(describe.means(df, ["rich", "near"], ["segment"], 100.0))


@query(
    "scalar_means",
    "SELECT count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels",
)
def scalar_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.means(table(spark, sf, "labels", "quality", "toxic"), ["quality", "toxic"]))


@query("freq_table", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def freq_table(spark: SparkSession, sf: str) -> DataFrame:
    return describe.frequency(table(spark, sf, "events", "event_type"), "event_type")


@query(
    "crosstab",
    """SELECT o_orderpriority AS c1, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "n_F",
    count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "n_O", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "n_P"
    FROM orders GROUP BY 1""",
)
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return describe.crosstab(headers(spark, sf), "c1", "c2", ["F", "O", "P"])


@query(
    "six_number",
    """SELECT event_type, variable, count(v) AS n, count(*) - count(v) AS n_missing, round(avg(v), 6) AS mean,
    round(stddev_samp(v), 6) AS sd, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median,
    round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max
    FROM (SELECT event_type, 'value' AS variable, value AS v FROM events UNION ALL
          SELECT event_type, 'user_id', CASE WHEN user_id > 5 THEN CAST(user_id AS DOUBLE) END FROM events) GROUP BY 1, 2""",
)
def six_number(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events", "event_type", "value", "user_id")
    df = df.withColumn("user_id", F.when(F.col("user_id") > 5, F.col("user_id")))
    return rounded(describe.six_number(df, ["value", "user_id"], ["event_type"]))


@query(
    "histogram",
    """SELECT c2, bin, count(*) AS n, round((bin - 1) * 0.05::DOUBLE, 9) AS bin_lo, round(bin * 0.05::DOUBLE, 9) AS bin_hi FROM (
    SELECT o_orderstatus AS c2, CAST(greatest(ceil(round((o_totalprice / 1000000) / 0.05, 9)), 1) AS INT) AS bin
    FROM orders WHERE o_totalprice >= 0) WHERE bin <= 20 GROUP BY 1, 2""",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    df = headers(spark, sf).select("c2", (F.col("amount") / 1000000).alias("share"))
    return describe.histogram(df, "share", ["c2"])


@query(
    "first_record",
    f"""WITH {SQL_H} SELECT id, claim, d, amount FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY d, amount DESC, claim) AS rn FROM h) WHERE rn = 1""",
)
def first_record(spark: SparkSession, sf: str) -> DataFrame:
    order = [("d", "asc"), ("amount", "desc"), ("claim", "asc")]
    return cohort.first_record(headers(spark, sf).select("id", "claim", "d", "amount"), "id", order)


@query(
    "random_rank",
    """SELECT c_custkey AS id, c_mktsegment AS segment,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':407'), c_custkey) AS rank FROM customer""",
)
def random_rank(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    return ordered.random_rank(df, ["segment"], ["id"], 407)


@query(
    "strata_sizes_blocks",
    """SELECT c_custkey AS id, c_mktsegment AS segment, CAST(ceil(row_number() OVER (PARTITION BY c_mktsegment
    ORDER BY md5(c_custkey || ':7'), c_custkey) / 3.0) AS BIGINT) AS block, n FROM customer
    JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) USING (c_mktsegment)""",
)
def strata_sizes_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Stratum sizes next to each row and blocks of three in random order, without splitting tables."""
    df = table(spark, sf, "customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    sizes = describe.frequency(df, "segment")
    ranked = ordered.random_rank(df, ["segment"], ["id"], 7)
    return ranked.join(sizes, "segment").select("id", "segment", F.ceil(F.col("rank") / 3).alias("block"), "n")


@query(
    "sorted_head",
    """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
    ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 30""",
)
def sorted_head(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows of a multi-key sort."""
    keys = cohort.sort_keys([("c_mktsegment", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc")])
    return table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal").orderBy(*keys).limit(30)


@query(
    "union_channels",
    f"""WITH {SQL_H} SELECT id, weight, count(*) AS n FROM (SELECT id, 1 AS weight FROM h WHERE c2 <> 'F'
    UNION ALL SELECT id, 2 FROM h WHERE c2 = 'F') GROUP BY 1, 2""",
)
def union_channels(spark: SparkSession, sf: str) -> DataFrame:
    h = headers(spark, sf).select("id", "c2")
    out = h.filter(F.col("c2") != "F").withColumn("weight", F.lit(1))
    return describe.frequency(out.unionByName(h.filter(F.col("c2") == "F").withColumn("weight", F.lit(2))), ["id", "weight"])


@query(
    "wide_to_long",
    f"""WITH {SQL_H} SELECT id, d AS func_date, slot, code, 1 AS weight FROM (
    SELECT id, d, 'c1' AS slot, c1 AS code FROM h UNION ALL SELECT id, d, 'c2', c2 FROM h)""",
)
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return history.long_codes([(headers(spark, sf), "d", SLOTS, 1)], "id")


@query(
    "long_to_wide",
    f"""WITH {SQL_H} SELECT id, max(CASE WHEN c2 = 'F' THEN 1 ELSE 0 END) AS "F", max(CASE WHEN c2 = 'O' THEN 1 ELSE 0 END) AS "O",
    max(CASE WHEN c2 = 'P' THEN 1 ELSE 0 END) AS "P" FROM h GROUP BY id""",
)
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Present labels to 0/1 columns with a given, fixed list of columns."""
    wide = headers(spark, sf).groupBy("id").pivot("c2", ["F", "O", "P"]).agg(F.max(F.lit(1)))
    return clean.zero_fill(wide, ["F", "O", "P"])


@query(
    "scalar_functions",
    f"""WITH {SQL_H} SELECT claim, c1 || '-' || c2 AS pasted, substr(strftime(d, '%Y%m%d'), 1, 6) AS ym,
    CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, d + 30 AS plus, CAST(DATE '{'2001-08-01'}' - d AS INT) AS days,
    CAST(ceil(amount / 1000) AS BIGINT) AS up, CAST(floor(amount / 1000) AS BIGINT) AS down, round(amount / 3, 2) AS r2,
    round(ln(amount), 6) AS ln_a, round(exp(amount / 1000000), 6) AS exp_a, CAST(year(d) - 1950 AS DOUBLE) AS age,
    CASE WHEN c2 = 'F' THEN 'yes' ELSE 'no' END AS pick FROM h""",
)
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("amount")
    return headers(spark, sf).select(
        "claim",
        F.concat_ws("-", "c1", "c2").alias("pasted"),
        F.substring(F.date_format("d", "yyyyMMdd"), 1, 6).alias("ym"),
        F.year("d").alias("y"),
        F.month("d").alias("m"),
        clean.last_day("d", F.lit(31.0)).alias("plus"),
        F.datediff(F.lit("2001-08-01").cast("date"), "d").alias("days"),
        F.ceil(a / 1000).alias("up"),
        F.floor(a / 1000).alias("down"),
        F.round(a / 3, 2).alias("r2"),
        F.round(F.ln(a), 6).alias("ln_a"),
        F.round(F.exp(a / 1000000), 6).alias("exp_a"),
        clean.age_at("d", F.lit(1950.0)).alias("age"),
        F.when(F.col("c2") == "F", "yes").otherwise("no").alias("pick"),
    )


@query(
    "label_codes",
    f"""WITH {SQL_H}, l AS (SELECT id, c1 AS code FROM h UNION ALL SELECT id, c2 FROM h) SELECT dx, count(*) AS n FROM (
    SELECT CASE WHEN code = 'F' THEN 'pre_filled' WHEN code LIKE '5-%' THEN 'pre_low' WHEN code LIKE '2-%' THEN 'pre_high'
    WHEN code LIKE '1-%' THEN 'pre_urgent' END AS dx FROM l) WHERE dx IS NOT NULL GROUP BY 1""",
)
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    long = history.long_codes([(headers(spark, sf), "d", SLOTS, 1)], "id")
    return describe.frequency(codes.label_codes(long, "code", LABELS, "pre_"), "dx")
