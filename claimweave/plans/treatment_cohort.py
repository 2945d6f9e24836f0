"""Cohort study: insulin and hypoglycaemia, from dispensing claims to hazard and rate ratios."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimweave.functions.clean import member, parse_date, parse_number
from claimweave.operators import claims, codes, cohort, describe, panel, survival
from claimweave.operators.cox import cox, ph_test
from claimweave.operators.fits import Fit
from claimweave.operators.regression import poisson_gee
from claimweave.plans.case_control import (
    CLAIM_KEY, IPD_SLOTS, OPD_SLOTS, Design, disease_history, enrolment_at_index,
)

# Drug classes, outcome codes, emergency settings, disease labels, income breaks and life
# table times that decide the study's results.
DRUG_CLASS = "^A10"
INSULIN_CLASS = "^A10A"
OUTCOME = "^251[0-2]"
EMERGENCY_CASE, EMERGENCY_DEPARTMENT = "02", "22"
DISEASES = (
    ("pneumonia", "^48[0-6]"),
    ("stroke", "^43[0-8]"),
    ("htn", "^40[1-5]"),
    ("lipoid", "^272"),
    ("ckd", "^585"),
    ("dysrhyth", "^427"),
)
INCOME_BREAKS = (0, 15840, 25000, 45000, 200000)
LIFE_TABLE_TIMES = (0, 60, 120, 180, 240, 300, 360)
COVARIATES = ("age", "male", "ins_amt_gp_2", "ins_amt_gp_3", "ins_amt_gp_4")


@dataclass(frozen=True)
class Period:
    """Study period."""

    start: str = "2014-01-01"
    end: str = "2014-12-31"


def visits(header: DataFrame, lines: DataFrame, drugs: DataFrame, hospital: str = "hosp_id") -> DataFrame:
    """Dispensing visits of one channel with their supply days and insulin flag."""
    wanted = claims.claim_flags(lines.join(drugs, "drug_no"), CLAIM_KEY, ["insulin"])
    who = list(dict.fromkeys(["id", "func_date", hospital, "prsn_id"]))
    heads = header.select(
        "id", parse_date("func_date").alias("func_date"), "prsn_id",
        parse_number("drug_day").alias("drug_day"), *dict.fromkeys([hospital, *CLAIM_KEY]),
    )
    rolled = claims.rollup(
        claims.link_claims(heads, wanted, CLAIM_KEY),
        list(dict.fromkeys([*who, *CLAIM_KEY])), who, ["drug_day"], ["insulin"], "propagate",
    )
    return rolled if hospital == "hosp_id" else rolled.withColumnRenamed(hospital, "hosp_id")


def treatment_episodes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Supply intervals from clinic and pharmacy claims; a prescriber's hospital stands for the pharmacy's."""
    drugs = codes.code_list(tables["drug_list"], "drug_no", "atc_code", DRUG_CLASS, {"insulin": INSULIN_CLASS})
    drugs = drugs.select("drug_no", "insulin")
    both = claims.merge_channels(
        [
            visits(tables["outpatient"], tables["outpatient_orders"], drugs),
            visits(tables["pharmacy"], tables["pharmacy_orders"], drugs, "r_hosp_id"),
        ],
        ["id", "func_date", "hosp_id", "prsn_id"], ["drug_day"], ["insulin"],
    )
    return claims.episodes(both, "func_date", "drug_day")


def index_dates(episodes: DataFrame) -> DataFrame:
    """First treatment day per person, with that visit's insulin flag."""
    first = cohort.first_record(
        episodes, "id", [("start_date", "asc"), ("hosp_id", "asc"), ("prsn_id", "asc")]
    )
    return first.select("id", F.col("start_date").alias("index_date"), "insulin")


def all_outcomes(tables: Mapping[str, DataFrame], people: DataFrame) -> DataFrame:
    """Days with the outcome in emergency outpatient or any inpatient claims."""
    emergency = tables["outpatient"].filter(
        (F.col("case_type") == EMERGENCY_CASE) | (F.col("func_type") == EMERGENCY_DEPARTMENT)
    )
    out = emergency.select("id", parse_date("func_date").alias("func_date"), *OPD_SLOTS)
    inp = tables["inpatient"].select("id", parse_date("in_date").alias("func_date"), *IPD_SLOTS)
    return cohort.outcome_events([(out, "func_date", OPD_SLOTS), (inp, "func_date", IPD_SLOTS)], people, "id", OUTCOME)


def person_months(
    selected: DataFrame, episodes: DataFrame, events: DataFrame, insured: DataFrame, period: Period = Period()
) -> DataFrame:
    """Person-month panel with exposure, event counts and covariates."""
    months = panel.person_periods(selected, "id", "index_date", period.start, period.end)
    exposed = panel.period_exposure(months, episodes, "id", "insulin", period.start, period.end)
    counted = panel.period_events(months, events, "id", period.start, period.end)
    return panel.assemble_panel(months, insured, exposed, counted, "id")


def run_treatment_cohort(
    tables: Mapping[str, DataFrame],
    period: Period = Period(),
    design: Design = Design(),
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> dict[str, DataFrame]:
    """All stage and descriptive tables. ``keep`` may store a stage and return the stored copy."""
    episodes = keep(treatment_episodes(tables), "pt_episode")
    first = keep(index_dates(episodes), "pt_first")
    every = keep(all_outcomes(tables, first), "xt_every")
    first_event = keep(cohort.first_record(every, "id", [("ot_date", "asc")]), "xt_first")
    insured = keep(enrolment_at_index(tables["enrolment"], first, "index_date", INCOME_BREAKS), "ins_first")
    past = keep(
        disease_history(tables["outpatient"], tables["inpatient"], first, "index_date", DISEASES, design, "code"),
        "hx_first",
    )
    merged = keep(
        cohort.analytic_frame(
            first, "id", first_event, [insured, past], [name for name, _ in DISEASES], study_end=period.end
        ),
        "pt_merge_first",
    )
    selected, attrition = cohort.select_cohort(
        merged,
        [
            ("no event up to the index date", ~(F.col("ot_date") <= F.col("index_date"))),
            (
                "complete enrolment data",
                member("id_s", ("1", "2")) & F.col("id_birth_y").isNotNull() & F.col("id1_amt").isNotNull(),
            ),
        ],
    )
    selected = keep(selected, "pt_select")
    curve = survival.kaplan_meier(selected, "ft", "ot", ["insulin"])
    return {
        "pt_episode": episodes,
        "pt_first": first,
        "xt_every": every,
        "xt_first": first_event,
        "ins_first": insured,
        "hx_first": past,
        "pt_merge_first": merged,
        "pt_select": selected,
        "attrition": attrition,
        "incidence": describe.incidence(selected, "ft", "ot", ["insulin"], 100000),
        "km": curve,
        "life_table": survival.life_table(curve, LIFE_TABLE_TIMES, ["insulin"]),
        "risk_table": survival.life_table(curve, LIFE_TABLE_TIMES, ["insulin"], extend=True),
        "pt_repeated": keep(person_months(selected, episodes, every, insured, period), "pt_repeated"),
    }


def fit_models(results: Mapping[str, DataFrame]) -> dict[str, Fit]:
    """Crude and adjusted Cox models and the person-month rate model."""
    selected = results["pt_select"]
    return {
        "cox_crude": cox(selected, "ft", "ot", ["insulin"]),
        "cox_adjusted": cox(selected, "ft", "ot", ["insulin", *COVARIATES, "htn"]),
        "gee": poisson_gee(results["pt_repeated"], "ot", ["insulin", *COVARIATES], "id"),
    }


def tests_of(results: Mapping[str, DataFrame], fits: Mapping[str, Fit]) -> dict[str, DataFrame]:
    """Log-rank test and proportional-hazards check."""
    selected = results["pt_select"]
    return {
        "logrank": survival.logrank(selected, "ft", "ot", "insulin"),
        "ph_test": ph_test(selected, fits["cox_adjusted"], "ft", "ot"),
    }
