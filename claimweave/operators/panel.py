"""Person-month panels with time-varying exposure and recurrent events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PERIOD = ["obs_ym", "obs_date_on", "obs_date_off"]


def _month(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")


def _months_between(first: Column, last: Column) -> Column:
    """First days of the calendar months touched by ``[first, last]``; none when the order is reversed."""
    return F.when(
        first <= last,
        F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")),
    )


def person_periods(cohort: DataFrame, by: str, index: str, start: str, end: str) -> DataFrame:
    """One row per person and calendar month from the index month to the end of the study.

    Each person generates only the months they need, so no product with a calendar is formed.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = _months_between(F.greatest(F.col(index), first), last)
    on = F.col("_month")
    return (
        cohort.filter(F.col(index).isNotNull())
        .select(by, index, F.explode(months).alias("_month"))
        .select(
            by,
            index,
            _month(on).alias("obs_ym"),
            F.greatest(on, first).alias("obs_date_on"),
            F.least(F.last_day(on), last).alias("obs_date_off"),
        )
    )


def period_exposure(
    panel: DataFrame,
    episodes: DataFrame,
    by: str,
    flag: str,
    start: str,
    end: str,
    index: str = "index_date",
    episode_start: str = "start_date",
    episode_end: str = "end_date",
) -> DataFrame:
    """1 in each month that an exposed episode overlaps, else 0; persons without episodes drop out.

    An unknown episode bound leaves the exposure on. Episodes are expanded to the months they touch and
    made distinct, so the work is linear in episodes and months instead of their pairs per person.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.greatest(F.coalesce(F.col(episode_start), lo), lo)
    last = F.least(F.coalesce(F.col(episode_end), hi), hi)
    # A supply of no or negative days ends before it starts; it still counts in a month that holds both days.
    months = _months_between(F.trunc(first, "month"), F.trunc(last, "month"))
    exposed = (
        episodes.filter((F.col(flag) == 1) & (first <= hi) & (last >= lo))
        .select(by, F.explode(months).alias("_month"))
        .select(by, _month(F.col("_month")).alias("obs_ym"))
        .distinct()
        .withColumn(flag, F.lit(1))
    )
    known = episodes.select(by).distinct()
    keys = [by, index, *PERIOD]
    return (
        panel.select(*keys)
        .join(known, by, "left_semi")
        .join(exposed, [by, "obs_ym"], "left")
        .select(*keys, F.coalesce(F.col(flag), F.lit(0)).alias(flag))
    )


def period_events(
    panel: DataFrame,
    events: DataFrame,
    by: str,
    start: str,
    end: str,
    date: str = "ot_date",
    index: str = "index_date",
    name: str = "ot",
) -> DataFrame:
    """Number of event days inside each person-month; ``events`` holds distinct (person, day) rows."""
    counted = (
        events.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy(by, _month(F.col(date)).alias("obs_ym"))
        .agg(F.count(F.lit(1)).alias(name))
    )
    keys = [by, index, *PERIOD]
    return (
        panel.select(*keys)
        .join(counted, [by, "obs_ym"], "left")
        .select(*keys, F.coalesce(F.col(name), F.lit(0)).alias(name))
    )


def assemble_panel(
    panel: DataFrame,
    covariates: DataFrame,
    exposure: DataFrame,
    events: DataFrame,
    by: str,
    index: str = "index_date",
) -> DataFrame:
    """Panel joined with covariates per person, and exposure and events per person-month."""
    keys: Sequence[str] = [by, index, *PERIOD]
    return (
        panel.join(exposure, list(keys), "inner")
        .join(events, list(keys), "inner")
        .join(covariates.drop(index), by, "inner")
    )
