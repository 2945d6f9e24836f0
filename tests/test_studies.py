"""The three studies end to end on generated claims, with stage checks in plain pandas."""

import datetime as dt
import random

import pandas as pd
import pytest

from claimweave.operators.fits import ratio_table
from claimweave.plans import case_control, propensity_study, treatment_cohort
from claimweave.sources.files import stage

KEY = list(case_control.CLAIM_KEY)
CODES = ["4019", "4011", "25000", "272", "585", "427", "486", "43301", "430", "2510", "2511", "780", "", None]


def day(rng, first="2014-01-01", span=365):
    return (dt.date.fromisoformat(first) + dt.timedelta(rng.randrange(span))).strftime("%Y%m%d")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    people = [f"p{i:03d}" for i in range(400)]
    ipd, ipo, opd, opo, phe, pho = [], [], [], [], [], []

    def key(n, date):
        return (rng.choice("ABC"), date[:6], "20150101", "1", rng.choice(["01", "02", "09"]), str(n))

    for n in range(900):
        p, date = rng.choice(people), day(rng)
        codes = [rng.choice(CODES) for _ in range(5)]
        if n < 500:
            codes[0] = rng.choice(["43301", "434", "430", "431"])
        k = key(n, date)
        ipd.append((p, date, *codes, str(rng.randrange(12)), rng.choice(["0", "3", "bad"]), *k))
        ipo += [(rng.choice(["47017C", "47013C", "X"]), *k) for _ in range(rng.randrange(0, 4))]
    for n in range(4000):
        p, date = rng.choice(people), day(rng)
        k = key(n, date)
        opd.append((p, date, rng.choice(["01", "22", "02"]), f"d{n % 7}", rng.choice(["28", "7", ""]), *[rng.choice(CODES) for _ in range(3)], *k))
        opo += [(rng.choice(["D1", "D2", "D3", "D4"]), *k) for _ in range(rng.randrange(0, 3))]
    for n in range(800):
        p, date = rng.choice(people), day(rng)
        k = key(n, date)
        phe.append((p, date, rng.choice("ABC"), "01", f"d{n % 7}", "14", *k))
        pho += [(rng.choice(["D1", "D2", "D4"]), *k)]
    enrol = [
        (p, rng.choice(["1", "2", "2", "1", "9"]), str(1930 + i % 60), f"2014{m:02d}", str(rng.choice([0, 15840, 20000, 30000, 60000])))
        for i, p in enumerate(people) for m in range(1, 13) if rng.random() < 0.8
    ]
    drugs = [("D1", "A10AB01"), ("D1", "A10AB01"), ("D2", "A10BA02"), ("D3", "C09AA01")]
    make = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).repartition(3)
    return {
        "inpatient": make(ipd, ["id", "in_date", *case_control.IPD_SLOTS, "e_bed_day", "s_bed_day", *KEY]),
        "inpatient_orders": make(ipo, ["order_code", *KEY]),
        "outpatient": make(opd, ["id", "func_date", "func_type", "prsn_id", "drug_day", *case_control.OPD_SLOTS, *KEY]),
        "outpatient_orders": make(opo, ["drug_no", *KEY]),
        "pharmacy": make(phe, ["id", "func_date", "r_hosp_id", "func_type", "prsn_id", "drug_day", *KEY]),
        "pharmacy_orders": make(pho, ["drug_no", *KEY]),
        "enrolment": make(enrol, ["id", "id_s", "id_birth_y", "prem_ym", "id1_amt"]),
        "drug_list": make(drugs, ["drug_no", "atc_code"]),
    }


def test_case_control(spark, tables):
    out = case_control.run_case_control(tables, keep=stage)
    ipd, ipo = tables["inpatient"].toPandas(), tables["inpatient_orders"].toPandas()
    linked = ipd.merge(ipo, on=KEY)
    linked["isk"] = linked.icd9cm_1.fillna("").str.contains("^43[34]").astype(int)
    linked["hsk"] = linked.icd9cm_1.fillna("").str.contains("^43[012]").astype(int)
    for c in ("e_bed_day", "s_bed_day"):
        linked[c] = pd.to_numeric(linked[c], errors="coerce")
    bills = linked.groupby(["id", "in_date", "hosp_id", "fee_ym"])[["e_bed_day", "s_bed_day", "isk", "hsk"]].max().reset_index()
    visit = bills.groupby(["id", "in_date", "hosp_id"]).agg(e=("e_bed_day", "sum"), s=("s_bed_day", "sum"), isk=("isk", "max"), hsk=("hsk", "max")).reset_index()
    visit["bed_day"] = visit.e + visit.s
    visit = visit[(visit.isk == 1) | (visit.hsk == 1)].sort_values(["id", "in_date", "bed_day", "hosp_id"], ascending=[True, True, False, True])
    want = visit.groupby("id").first()
    got = out["pt_adm"].toPandas().set_index("id")
    assert len(got) == len(want) > 100
    assert (got.bed_day.sort_index() == want.bed_day).all() and (got.hosp_id.sort_index() == want.hosp_id).all()

    merged = out["pt_merge"].toPandas()
    assert len(merged) == len(want) and merged[[f"pre_{n}" for n, _ in case_control.DISEASES]].notna().all().all()
    keep = merged[(pd.to_datetime(merged.in_date).dt.month >= 4) & (merged.pre_stroke != 1) & merged.id_s.isin(["1", "2"])]
    assert set(out["pt_select"].toPandas().id) == set(keep.id)
    steps = [r.n for r in out["attrition"].orderBy("step").collect()]
    assert steps[0] == len(merged) and steps[-1] == len(keep) and steps == sorted(steps, reverse=True)

    matched = out["pt_match"].toPandas()
    sizes = matched.groupby(["gg", "bed_day_7"]).size().unstack()
    assert (sizes[1] == 1).all() and (sizes[0] == 2).all() and matched.id.is_unique
    assert out["balance"].count() == 4
    assert out["table_1"].count() > 20 and out["table_2"].count() > 20
    fits = case_control.fit_models(out["pt_match"], profile=False)
    assert fits["crude"].converged and fits["conditional"].stats["events"] == matched.bed_day_7.sum()
    assert ratio_table(fits["conditional"]).count() == 5


def test_treatment_cohort(spark, tables):
    out = treatment_cohort.run_treatment_cohort(tables, keep=stage)
    selected = out["pt_select"].toPandas()
    assert len(selected) > 50 and (selected.ft > 0).all() and selected.id.is_unique
    events = out["xt_every"].toPandas()
    first = events.groupby("id").ot_date.min()
    hit = selected[selected.ot == 1].set_index("id")
    assert (first.loc[hit.index] == hit.ot_date).all()
    panel = out["pt_repeated"].toPandas()
    months = pd.to_datetime(selected.index_date).dt.month
    assert len(panel) == (13 - months).sum()
    in_month = panel.merge(events, on="id", suffixes=("", "_ev"))
    in_month = in_month[(in_month.ot_date >= in_month.obs_date_on) & (in_month.ot_date <= in_month.obs_date_off)]
    assert panel.ot.sum() == len(in_month)
    assert out["incidence"].toPandas().tot_event.sum() == selected.ot.sum()
    assert out["life_table"].count() <= out["risk_table"].count() == 14
    fits = treatment_cohort.fit_models(out)
    assert fits["cox_adjusted"].converged and fits["gee"].converged
    assert fits["gee"].stats["clusters"] == len(selected)
    tests = treatment_cohort.tests_of(out, fits)
    assert tests["logrank"].count() == 2 and tests["ph_test"].count() == 8


def test_propensity_study(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        age = 50 + rng.randrange(40)
        flags = [int(rng.random() < 0.4) for _ in range(5)]
        noac = int(rng.random() < 0.2 + 0.005 * (age - 50) + 0.2 * flags[1])
        t = round(rng.expovariate(0.4 + 0.1 * flags[0]), 3) + 0.001
        rows.append((f"p{i}", *flags, age, noac, int(t < 2), min(t, 2.0)))
    cols = "id string, male int, htn int, dm int, hyperlipidemia int, malignancy int, age int, noac int, stroke_ot int, stroke_ft double"
    df = spark.createDataFrame(rows, cols).persist()
    sets, model = propensity_study.designs(df, "id", "noac")
    sets = {n: d.persist() for n, d in sets.items()}
    out = propensity_study.compare(sets, "noac", "stroke_ft", "stroke_ot")
    smd = out["baseline"].toPandas().set_index(["design", "variable"]).smd
    assert smd["matched", "htn"] < smd["crude", "htn"] and smd["weighted", "htn"] < smd["crude", "htn"]
    matched = sets["matched"].toPandas()
    assert (matched.groupby("pair_id").noac.agg(["sum", "size"]) == [1, 2]).all().all()
    gap = matched.groupby("pair_id").ps.agg(lambda v: v.max() - v.min()).max()
    assert gap <= 0.2 * sets["crude"].toPandas().ps.std() + 1e-12
    assert sets["weighted"].toPandas().iptw.mean() == pytest.approx(1.0, abs=0.05)
    assert out["cox"].groupBy("design").count().count() == 3 and out["ps_histogram"].count() > 2
    assert out["risk_table"].count() == 3 * 2 * 5
