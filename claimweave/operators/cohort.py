"""Index records, covariates at index, outcomes, the analytic frame and its selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.functions.clean import (
    age_at, any_code_match, bracket, censor, dummies, flag, in_lookback, member, parse_number, zero_fill,
)

Order = Sequence[tuple[str, str]]


def sort_keys(order: Order) -> list[Column]:
    """``[(column, 'asc' | 'desc')]`` as sort keys with missing values last."""
    return [
        F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in order
    ]


def first_record(df: DataFrame, by: str | Sequence[str], order: Order) -> DataFrame:
    """First row of each group. ``order`` must be total for a repeatable choice.

    Filtering ``row_number() = 1`` lets Spark keep one row per group on the map side already, so a
    person with very many rows is reduced before the shuffle.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*sort_keys(order)))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def latest_before(
    records: DataFrame,
    cohort: DataFrame,
    by: str,
    date: str,
    index: str,
    tie_break: Order,
) -> DataFrame:
    """Latest record dated strictly before each person's index date (as-of join).

    ``cohort`` has one row per person. Persons without an earlier record drop out.
    """
    joined = records.join(cohort.select(by, index), by, "inner").filter(F.col(date) < F.col(index))
    return first_record(joined, by, [(date, "desc"), *tie_break])


def records_in_window(
    records: DataFrame, cohort: DataFrame, by: str, date: str, index: str, days: int
) -> DataFrame:
    """Records in the half-open window ``[index - days, index)`` of the person (interval join)."""
    return records.join(cohort.select(by, index), by, "inner").filter(in_lookback(date, index, days))


def restrict_to(df: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """Rows of the persons in ``ids``."""
    return df.join(ids.select(by), by, "left_semi")


def demographics(
    latest: DataFrame,
    index: str,
    breaks: Sequence[float],
    sex: str = "id_s",
    birth_year: str = "id_birth_y",
    amount: str = "id1_amt",
    sexes: tuple[str, str] = ("1", "2"),
    bracket_name: str = "ins_amt_gp",
) -> DataFrame:
    """Sex, age at index and income bracket from an enrolment record; incomplete records drop out."""
    labels = list(range(1, len(breaks)))
    cleaned = (
        latest.withColumns({birth_year: parse_number(birth_year), amount: parse_number(amount)})
        .filter(F.col(birth_year).isNotNull() & F.col(amount).isNotNull() & member(sex, sexes))
        .withColumns(
            {
                "male": flag(F.col(sex) == sexes[0]),
                "female": flag(F.col(sex) == sexes[1]),
                "age": age_at(index, birth_year),
                bracket_name: bracket(amount, breaks, labels),
            }
        )
    )
    return dummies(cleaned, bracket_name, labels)


def outcome_events(
    sources: Sequence[tuple[DataFrame, str, Sequence[str]]],
    ids: DataFrame | None,
    by: str,
    pattern: str,
    date_name: str = "ot_date",
    event_name: str = "ot",
) -> DataFrame:
    """Distinct (person, day) with a matching code in any slot of any source.

    ``sources`` lists ``(table, date column, code columns)``; filter by care setting beforehand. Testing
    the slots in place gives the same days as stacking them first, without multiplying rows.
    """
    parts = [
        df.filter(any_code_match(cols, pattern)).select(F.col(by), F.col(date).alias(date_name))
        for df, date, cols in sources
    ]
    hits = reduce(DataFrame.unionByName, parts)
    if ids is not None:
        hits = restrict_to(hits, ids, by)
    return hits.distinct().withColumn(event_name, F.lit(1))


def analytic_frame(
    cohort: DataFrame,
    by: str,
    outcome: DataFrame | None = None,
    tables: Sequence[DataFrame] = (),
    fill: Sequence[str] = (),
    index: str = "index_date",
    study_end: str | None = None,
    event: str = "ot",
    event_date: str = "ot_date",
    follow_up: str = "ft",
) -> DataFrame:
    """Left-join person-level tables; missing history is 0, missing outcome is censored at study end."""
    out = cohort
    if outcome is not None:
        if study_end is None:
            raise ValueError("an outcome needs the end of the study for censoring")
        out = censor(out.join(outcome, by, "left"), event, event_date, study_end)
        out = out.withColumn(follow_up, F.datediff(event_date, index).cast("double"))
    for table in tables:
        out = out.join(table, by, "left")
    return zero_fill(out, fill) if fill else out


def select_cohort(df: DataFrame, criteria: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Apply named criteria in order; return the selection and its attrition table.

    A row whose criterion is unknown is dropped. All counts come from one pass over the data.
    """
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("c0")]
    for i, (_, condition) in enumerate(criteria, start=1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(f"c{i}"))
    names = ["all", *[name for name, _ in criteria]]
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("criterion"),
            F.col(f"c{i}").alias("n"),
            (F.col(f"c{max(i - 1, 0)}") - F.col(f"c{i}")).alias("n_dropped"),
        )
        for i, name in enumerate(names)
    ]
    attrition = df.agg(*counts).select(F.inline(F.array(*rows)))
    return df.filter(kept), attrition


def timeline_of_kth(df: DataFrame, by: str, condition: Column, k: int, order: Order) -> DataFrame:
    """All rows of the k-th person (in id order) who ever meets a condition."""
    first_k = df.filter(condition).select(by).distinct().orderBy(by).limit(k)
    chosen = first_k.agg(F.max(by).alias(by), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == k)
    return df.join(chosen.select(by), by, "left_semi").orderBy(*sort_keys(order))
