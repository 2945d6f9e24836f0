"""Physical plans: pruning, pushdown, no products of tables, and hot keys split or reduced early."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from claimweave.operators import cohort, history, matching, ordered, survival
from claimweave.plans import registry

SF = "/root/testdata/sf0.001"
# Queries that fit a model or store a table run jobs while they are built; their result is a small table.
EAGER = {
    "stage_roundtrip", "csv_with_header", "csv_after_preamble", "logrank", "logrank_groups", "psm_pairs", "design_comparison", "fit_summary", "labels_odds",
    "ps_saturated", "iptw", "ps_histogram", "weighted_smd_iptw", "rate_ratio_table", "psm_given_score", "concordance_of_fit",
}
LAZY = [
    n for n in registry.queries()
    if n not in EAGER and not n.startswith(("cox", "logit", "gee", "clogit", "odds", "rate_ratio"))
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_python(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in text, word


def test_scan_is_pruned_and_filtered(spark):
    text = plan(registry.queries()["scan_columns"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,250000" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_first_record_limits_before_the_shuffle(spark):
    text = plan(registry.queries()["first_record"](spark, SF))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


@pytest.fixture
def small_skew_threshold(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_records(spark, n=200_000):
    """A third of all records belong to person 0."""
    k = F.col("k")
    day = F.date_add(F.lit(dt.date(2014, 1, 1)), F.pmod(F.hash("k"), F.lit(300)).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "k").repartition(8)
    return rows.select(F.when(k % 3 == 0, 0).otherwise(k % 5000).alias("id"), day.alias("d"), "k")


def test_hot_person_is_split_in_the_as_of_join(spark, small_skew_threshold):
    people = spark.range(5000).select("id", F.lit(dt.date(2014, 9, 1)).alias("index_date"))
    out = cohort.latest_before(hot_records(spark), people, "id", "d", "index_date", [("k", "asc")])
    assert out.count() == hot_records(spark).filter("d < '2014-09-01'").select("id").distinct().count()
    out.collect()
    assert "skew=true" in plan(out)


def test_hot_stratum_is_ranked_in_buckets(spark):
    df = spark.range(60_000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50))
    ranked = ordered.random_rank(df, ["g"], ["id"], 3)
    assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+L?, _bucket#\d+", plan(ranked))
    biggest = ordered.hash_buckets(df, ["id"], 3).groupBy("g", ordered.BUCKET).count().agg(F.max("count")).first()[0]
    assert biggest < 60
    check = ranked.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d"))
    assert check.filter("n <> m OR n <> d").isEmpty()


def test_hot_score_matches_every_person_once(spark):
    """A third of all persons share one score; flows are unrolled in chunks and nobody is lost."""
    df = spark.range(6000).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("t"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 997) / 997).alias("ps"),
    )
    out = matching.ps_match(df, "id", "t", "ps", caliper=0.001, chunk=50)
    assert out.groupBy("id").count().filter("count > 1").isEmpty()
    at_hot = out.filter("ps = 0.5").groupBy("t").count().collect()
    assert {r.t: r["count"] for r in at_hot} == {0: 1000, 1: 1000}


def test_curve_over_continuous_times(spark):
    """Many distinct times: running sums cross buckets and still equal the plain product."""
    df = spark.range(4000).select((F.abs(F.hash("id")) / 1e6).alias("t"), (F.col("id") % 2).cast("int").alias("e"))
    curve = survival.kaplan_meier(df, "t", "e").orderBy("time").collect()
    rows = sorted((r.t, r.e) for r in df.collect())
    s, left = 1.0, len(rows)
    for row, (t, e) in zip(curve, rows):
        s *= 1 - e / left
        assert row.n_risk == left and abs(row.surv - s) < 1e-9
        left -= 1


def test_history_shuffles_records_of_the_cohort_once(spark):
    """The join with the cohort lies below the first exchange, and the sums use its partitioning."""
    records = spark.range(3000).select((F.col("id") % 300).alias("pid"), F.date_add(F.lit(dt.date(2014, 1, 1)), (F.col("id") % 90).cast("int")).alias("d"), F.lit("A1").alias("c1"))
    people = spark.range(0, 300, 3).select(F.col("id").alias("pid"), F.lit(dt.date(2014, 3, 1)).alias("index_date"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    out = lambda: history.history([(records, "d", ["c1"], 2)], people, "pid", "index_date", [("a", "^A")], 30)
    assert plan(out()).index("BroadcastHashJoin") > plan(out()).rindex("Exchange hashpartitioning(pid")
    assert out().count() == 100
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = out()
        assert len(re.findall(r"Exchange hashpartitioning\(pid", plan(df))) == 2  # records and cohort
        assert df.count() == 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
