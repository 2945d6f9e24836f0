"""From claim headers and order lines to stays, visits and treatment episodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.clean import last_day


def group_max(c: str, null_policy: str = "skip") -> Column:
    """Group maximum; ``propagate`` gives null as soon as one value is missing."""
    return _with_nulls(F.max(c), c, null_policy)


def group_sum(c: str, null_policy: str = "skip") -> Column:
    """Group sum; ``skip`` gives 0 for a group of missing values, ``propagate`` null for any missing one."""
    if null_policy == "skip":
        return F.coalesce(F.sum(c), F.lit(0))
    return _with_nulls(F.sum(c), c, null_policy)


def _with_nulls(aggregate: Column, c: str, null_policy: str) -> Column:
    if null_policy == "skip":
        return aggregate
    if null_policy != "propagate":
        raise ValueError("null_policy is 'skip' or 'propagate'")
    return F.when(F.count(c) == F.count(F.lit(1)), aggregate)


def claim_flags(detail: DataFrame, key: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Reduce order lines to one row per claim before they meet the headers.

    The maximum is taken again at every later level, so taking it first changes no result; it removes
    the fan-out of the join and any claim with very many lines.
    """
    return detail.groupBy(*key).agg(*[F.max(c).alias(c) for c in flags])


def link_claims(header: DataFrame, detail: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join headers to order lines on the claim key; ``inner`` drops claims without lines."""
    return header.join(detail, list(key), how)


def rollup(
    df: DataFrame,
    inner_key: Sequence[str],
    outer_key: Sequence[str],
    sum_cols: Sequence[str],
    max_cols: Sequence[str],
    null_policy: str = "skip",
) -> DataFrame:
    """Maximum inside each bill, then sums of quantities and maxima of flags per stay or visit."""
    bills = df.groupBy(*inner_key).agg(*[group_max(c, null_policy).alias(c) for c in [*sum_cols, *max_cols]])
    return bills.groupBy(*outer_key).agg(
        *[group_sum(c, null_policy).alias(c) for c in sum_cols],
        *[group_max(c, null_policy).alias(c) for c in max_cols],
    )


def merge_channels(
    channels: Sequence[DataFrame],
    key: Sequence[str],
    sum_cols: Sequence[str],
    max_cols: Sequence[str],
    null_policy: str = "propagate",
) -> DataFrame:
    """Stack visit tables of several dispensing channels and merge rows of the same visit."""
    return (
        reduce(DataFrame.unionByName, channels)
        .groupBy(*key)
        .agg(
            *[group_sum(c, null_policy).alias(c) for c in sum_cols],
            *[group_max(c, null_policy).alias(c) for c in max_cols],
        )
    )


def episodes(
    df: DataFrame, start: str, days: str, start_name: str = "start_date", end_name: str = "end_date"
) -> DataFrame:
    """Closed supply interval ``[start, start + days - 1]`` of each visit."""
    named = df.withColumn(end_name, last_day(start, days))
    return named if start == start_name else named.withColumnRenamed(start, start_name)
