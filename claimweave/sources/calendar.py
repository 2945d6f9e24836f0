"""Study calendars; their size depends on the study length only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def study_days(spark: SparkSession, start: str, end: str, name: str = "obs_date") -> DataFrame:
    """One row per day of ``[start, end]``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))


def days_between(bounds: DataFrame, first: str, last: str, name: str = "obs_date") -> DataFrame:
    """One row per day between two date columns of a bounds table."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(name))


def months_of(days: DataFrame, day: str = "obs_date") -> DataFrame:
    """First and last listed day of each calendar month."""
    month = F.substring(F.date_format(day, "yyyyMMdd"), 1, 6)
    return (
        days.groupBy(month.alias("obs_ym"))
        .agg(F.min(day).alias("obs_date_on"), F.max(day).alias("obs_date_off"))
    )
