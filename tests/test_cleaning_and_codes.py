"""Cleaning rules, code flags, brackets, missing-value policies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.functions import clean, tails
from claimweave.operators import claims, codes, describe
from claimweave.plans import case_control
from claimweave.sources import calendar, files


def d(text):
    return dt.date.fromisoformat(text)


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("k").collect()]


def test_stroke_flags_by_primary_code(spark):
    rows = list(enumerate(["43301", "434", "430", "435", "1433", "", None]))
    df = codes.flag_codes(spark.createDataFrame(rows, "k int, icd9cm_1 string"), {
        n: case_control.STAY_FLAGS[n] for n in ("isk", "hsk")
    })
    assert values(df, "isk") == [1, 1, 0, 0, 0, 0, 0]
    assert values(df, "hsk") == [0, 0, 1, 0, 0, 0, 0]


def test_secondary_slots_only_and_never_null(spark):
    rows = [(0, "486", None, None), (1, None, None, "486"), (2, None, "487", None)]
    df = spark.createDataFrame(rows, "k int, c1 string, c2 string, c3 string")
    df = codes.flag_codes(df, {"pneumonia": ("^48[0-6]", ["c2", "c3"])})
    assert values(df, "pneumonia") == [0, 1, 0]


def test_order_flags(spark):
    df = spark.createDataFrame([(0, "47017C"), (1, "47013C"), (2, None)], "k int, order_code string")
    df = codes.flag_orders(df, "order_code", case_control.ORDER_FLAGS)
    assert values(df, "ng_tube", "urin_cath") == [(1, 0), (0, 1), (0, 0)]


def test_brackets_are_right_closed(spark):
    amounts = [-1.0, 0.0, 15840.0, 15840.01, 25000.0, 25001.0, 200000.0, 200001.0, None]
    df = spark.createDataFrame(list(enumerate(amounts)), "k int, a double")
    df = df.withColumn("b", clean.bracket("a", [0, 15840, 25000, 200000], [1, 2, 3]))
    assert values(df, "b") == [None, 1, 1, 2, 2, 3, 3, None, None]
    four = df.select("k", clean.bracket(F.lit(45000) + F.col("k"), [0, 15840, 25000, 45000, 200000], [1, 2, 3, 4]).alias("b"))
    assert values(four, "b")[:2] == [3, 4]
    dummy = clean.dummies(df, "b", [1, 2, 3])
    assert values(dummy, "b_1", "b_2", "b_3")[3] == (0, 1, 0)
    assert values(dummy, "b_1", "b_2", "b_3")[0] == (None, None, None)


def test_unreadable_text_becomes_null(spark):
    df = spark.createDataFrame(
        [(0, "20140510", "201405", " 12 "), (1, "2014-05-10", "2014XX", "1e3"), (2, "20140230", None, "12d"), (3, "", "", "")],
        "k int, a string, m string, n string",
    )
    out = df.select("k", clean.parse_date("a").alias("a"), clean.parse_month("m").alias("m"), clean.parse_number("n").alias("n"))
    assert values(out, "a") == [d("2014-05-10"), d("2014-05-10"), None, None]
    assert values(out, "m") == [d("2014-05-01"), None, None, None]
    assert values(out, "n") == [12.0, 1000.0, None, None]


def test_null_policies(spark):
    df = spark.createDataFrame([(1, 3.0), (1, None), (2, None)], "k int, x double")
    out = df.groupBy("k").agg(
        claims.group_max("x").alias("ms"), claims.group_max("x", "propagate").alias("mp"),
        claims.group_sum("x").alias("ss"), claims.group_sum("x", "propagate").alias("sp"),
    )
    assert values(out, "ms", "mp", "ss", "sp") == [(3.0, None, 3.0, None), (None, None, 0.0, None)]


def test_labels_last_match_wins(spark):
    df = spark.createDataFrame([(0, "4011"), (1, "25000"), (2, "999"), (3, None)], "k int, code string")
    out = codes.label_codes(df, "code", [("any", "^[24]"), ("htn", "^40[1-5]")], "pre_")
    assert values(out, "dx") == ["pre_htn", "pre_any"]


def test_outcome_class_is_the_intended_one(spark):
    from claimweave.plans.treatment_cohort import OUTCOME

    df = spark.createDataFrame(list(enumerate(["2510", "2511", "2512", "2513"])), "k int, c string")
    assert values(df.withColumn("m", clean.code_match("c", OUTCOME)), "m") == [True, True, True, False]
    with pytest.warns(UserWarning):
        clean.code_match("c", "^251[0\N{EN DASH}2]")


def test_preamble_lines_are_dropped_by_content(spark, tmp_path):
    path = tmp_path / "drug_list.csv"
    path.write_text('藥品清單, 2014\ndrug_no,atc_code,name\nA1,A10AB01,"x, y"\nA2,A10BA02,z\n', encoding="utf-8")
    df = files.read_delimited_with_preamble(
        spark, str(path), "drug_no string, atc_code string, name string", "drug_no,atc_code,name", ["藥品清單, 2014"]
    )
    assert sorted(map(tuple, df.collect())) == [("A1", "A10AB01", "x, y"), ("A2", "A10BA02", "z")]
    listed = codes.code_list(df, "drug_no", "atc_code", "^A10", {"insulin": "^A10A"})
    assert {r.drug_no: r.insulin for r in listed.collect()} == {"A1": 1, "A2": 0}


def test_plain_csv_and_stage_files(spark, tmp_path):
    path = tmp_path / "demo.csv"
    path.write_text("male,age\n1,70.5\n0,61\n", encoding="utf-8")
    df = files.read_delimited(spark, str(path), "male int, age double")
    kept = files.stage(df, "demo")
    assert sorted(map(tuple, kept.collect())) == [(0, 61.0), (1, 70.5)]
    only = files.read_columns(spark, kept.inputFiles()[0].rsplit("/", 1)[0], ["age"])
    assert only.columns == ["age"]


def test_calendar_months(spark):
    months = calendar.months_of(calendar.study_days(spark, "2014-01-01", "2014-12-31")).orderBy("obs_ym").collect()
    assert len(months) == 12
    assert (months[1].obs_ym, months[1].obs_date_on, months[1].obs_date_off) == ("201402", d("2014-02-01"), d("2014-02-28"))


def test_chi_square_and_normal_tails():
    assert tails.chi2_tail(2.882353, 1) == pytest.approx(0.089555, abs=1e-6)
    assert tails.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_smd_and_histogram(spark):
    rows = [(1, float(i < 5)) for i in range(10)] + [(0, float(i < 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "t int, x double")
    assert describe.baseline_smd(df, "t", [], ["x"]).first().smd == pytest.approx(0.417029, abs=1e-6)
    h = spark.createDataFrame([(0.0,), (0.05,), (0.15,), (0.151,), (1.0,), (1.2,), (None,)], "x double")
    assert {r.bin: r.n for r in describe.histogram(h, "x").collect()} == {1: 2, 3: 1, 4: 1, 20: 1}
