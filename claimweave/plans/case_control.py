"""Case-control study: stroke type and length of stay, from inpatient claims to odds ratios."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimweave.functions.clean import flag, member, parse_date, parse_month, parse_number
from claimweave.operators import claims, codes, cohort, describe, matching
from claimweave.operators.cox import conditional_logistic
from claimweave.operators.fits import Fit
from claimweave.operators.history import history
from claimweave.operators.regression import logistic

# Claim key, code patterns, order codes, disease labels, income breaks and design numbers
# that decide the study's results.
CLAIM_KEY = ("hosp_id", "fee_ym", "appl_date", "appl_type", "case_type", "seq_no")
IPD_SLOTS = ("icd9cm_1", "icd9cm_2", "icd9cm_3", "icd9cm_4", "icd9cm_5")
OPD_SLOTS = ("icd9cm_1", "icd9cm_2", "icd9cm_3")
STAY_FLAGS = {
    "isk": ("^43[34]", IPD_SLOTS[:1]),
    "hsk": ("^43[012]", IPD_SLOTS[:1]),
    "pneumonia": ("^48[0-6]", IPD_SLOTS[1:]),
}
ORDER_FLAGS = {"ng_tube": ("47017C", "47018C"), "urin_cath": ("47013C", "47014C")}
DISEASES = (
    ("pneumonia", "^48[0-6]"),
    ("stroke", "^43[0-8]"),
    ("dm", "^250"),
    ("htn", "^40[1-5]"),
    ("lipoid", "^272"),
    ("ckd", "^585"),
    ("dysrhyth", "^427"),
)
INCOME_BREAKS = (0, 15840, 25000, 200000)


@dataclass(frozen=True)
class Design:
    """Study parameters."""

    lookback_days: int = 90
    min_weight: int = 2
    first_month: int = 4
    long_stay_days: int = 7
    old_age: int = 65
    ratio: int = 2
    seed: int = 407


def first_stays(header: DataFrame, orders: DataFrame) -> DataFrame:
    """Each person's first stroke stay with its flags and bed days."""
    heads = codes.flag_codes(
        header.select("id", parse_date("in_date").alias("in_date"), *IPD_SLOTS,
                      parse_number("e_bed_day").alias("e_bed_day"), parse_number("s_bed_day").alias("s_bed_day"),
                      *CLAIM_KEY),
        STAY_FLAGS,
    ).drop(*IPD_SLOTS)
    lines = codes.flag_orders(orders.select("order_code", *CLAIM_KEY), "order_code", ORDER_FLAGS)
    lines = claims.claim_flags(lines, CLAIM_KEY, list(ORDER_FLAGS))
    stays = claims.rollup(
        claims.link_claims(heads, lines, CLAIM_KEY),
        ["id", "in_date", "hosp_id", "fee_ym"],
        ["id", "in_date", "hosp_id"],
        ["e_bed_day", "s_bed_day"],
        [*STAY_FLAGS, *ORDER_FLAGS],
    ).withColumn("bed_day", F.col("s_bed_day") + F.col("e_bed_day"))
    strokes = stays.filter((F.col("isk") == 1) | (F.col("hsk") == 1))
    return cohort.first_record(strokes, "id", [("in_date", "asc"), ("bed_day", "desc"), ("hosp_id", "asc")])


def enrolment_at_index(
    enrolment: DataFrame, people: DataFrame, index: str, breaks: Sequence[float] = INCOME_BREAKS
) -> DataFrame:
    """Sex, age and income of the latest enrolment month before the index date."""
    months = enrolment.select("id", "id_s", "id_birth_y", "id1_amt", parse_month("prem_ym").alias("prem_date"))
    ties = [("id_s", "asc"), ("id_birth_y", "asc"), ("id1_amt", "asc")]
    latest = cohort.latest_before(months, people, "id", "prem_date", index, ties)
    return cohort.demographics(latest, index, breaks).drop(index, "prem_date")


def disease_history(
    outpatient: DataFrame,
    inpatient: DataFrame,
    people: DataFrame,
    index: str,
    labels: Sequence[tuple[str, str]],
    design: Design = Design(),
    dedupe: str = "dx",
    prefix: str = "",
) -> DataFrame:
    """Diseases on two outpatient days or one inpatient day before the index date."""
    out = outpatient.select("id", parse_date("func_date").alias("func_date"), *OPD_SLOTS)
    inp = inpatient.select("id", parse_date("in_date").alias("func_date"), *IPD_SLOTS)
    return history(
        [(out, "func_date", OPD_SLOTS, 1), (inp, "func_date", IPD_SLOTS, 2)],
        people, "id", index, labels, design.lookback_days, dedupe, design.min_weight, prefix,
    )


def select_and_match(
    merged: DataFrame, design: Design = Design()
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Selection, its attrition, the selection with outcome and age group, and the matched sets."""
    selected, attrition = cohort.select_cohort(
        merged,
        [
            ("admitted from the first full look-back month", F.month("in_date") >= design.first_month),
            ("no earlier stroke", F.col("pre_stroke") != 1),
            (
                "complete enrolment data",
                member("id_s", ("1", "2")) & F.col("id_birth_y").isNotNull() & F.col("id1_amt").isNotNull(),
            ),
        ],
    )
    outcome = selected.withColumns(
        {
            "bed_day_7": flag(F.col("bed_day") > design.long_stay_days),
            "age_65": flag(F.col("age") >= design.old_age),
        }
    )
    matched = matching.frequency_match(outcome, "bed_day_7", ["age_65", "male"], design.ratio, design.seed, "id")
    return selected, attrition, outcome, matched


def run_case_control(
    tables: Mapping[str, DataFrame],
    design: Design = Design(),
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> dict[str, DataFrame]:
    """All stage and result tables. ``keep`` may store a stage and return the stored copy."""
    stays = keep(first_stays(tables["inpatient"], tables["inpatient_orders"]), "pt_adm")
    insured = keep(enrolment_at_index(tables["enrolment"], stays, "in_date"), "ins")
    past = keep(
        disease_history(tables["outpatient"], tables["inpatient"], stays, "in_date", DISEASES, design, prefix="pre_"),
        "hx",
    )
    diseases = [f"pre_{name}" for name, _ in DISEASES]
    merged = keep(cohort.analytic_frame(stays, "id", tables=[insured, past], fill=diseases), "pt_merge")
    selected, attrition, outcome, matched = select_and_match(merged, design)
    selected, matched = keep(selected, "pt_select"), keep(matched, "pt_match")
    return {
        "pt_adm": stays,
        "ins": insured,
        "hx": past,
        "pt_merge": merged,
        "pt_select": selected,
        "attrition": attrition,
        "pt_match": matched,
        "balance": describe.balance(
            outcome.select("bed_day_7", "hsk", "age_65", "male"),
            matched.select("bed_day_7", "hsk", "age_65", "male"),
            "bed_day_7", ["hsk", "age_65", "male"],
        ),
        "table_1": describe.table_one(
            selected, "isk", ["id_s", "ins_amt_gp", "pneumonia", "ng_tube", "urin_cath"], ["age", "bed_day"],
            stats=("pct", "mean", "sd", "median"),
        ),
        "table_2": describe.table_one(
            matched, "bed_day_7", ["id_s", "age_65", "ins_amt_gp", "hsk", "pre_dm", "pre_htn"], ["age"],
            stats=("pct", "mean", "sd", "median"),
        ),
    }


def fit_models(matched: DataFrame, profile: bool = True) -> dict[str, Fit]:
    """Crude, adjusted and conditional logistic models of a long stay."""
    adjusted = ["hsk", "ins_amt_gp_1", "ins_amt_gp_3", "pre_dm", "pre_htn"]
    return {
        "crude": logistic(matched, "bed_day_7", ["hsk"], profile=profile),
        "adjusted": logistic(matched, "bed_day_7", adjusted, profile=profile),
        "conditional": conditional_logistic(matched, "bed_day_7", adjusted, "gg"),
    }
