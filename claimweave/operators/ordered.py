"""Ranks and running sums that never sort a whole group in one task.

A plain ``Window.partitionBy(stratum)`` puts every row of a stratum on one task. Both helpers here cut
each group into ordered buckets, turn bucket totals into offsets, and run the window inside a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET = "_bucket"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the left copy of the keys is kept."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(and_, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def hash_key(ids: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random sort key of a row: the same on any partitioning and any run."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def hash_buckets(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """Add ``_hash`` and its 3-hex-digit prefix, which orders rows into at most 4096 even buckets."""
    return df.withColumn("_hash", hash_key(ids, seed)).withColumn(BUCKET, F.substring("_hash", 1, 3))


def bucket_offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (group, bucket) and how many rows of the group lie in earlier buckets."""
    counts = df.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def random_rank(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int, name: str = "rank") -> DataFrame:
    """Number the rows of each group 1..n in seeded pseudo-random order."""
    hashed = hash_buckets(df, ids, seed)
    offsets = bucket_offsets(hashed, by).drop("_n")
    inside = W.partitionBy(*by, BUCKET).orderBy("_hash", *ids)
    return (
        null_safe_join(hashed, offsets, [*by, BUCKET])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_hash", BUCKET, "_before")
    )


def value_buckets(df: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Cut an ordered column into even ranges, using approximate quantiles of all rows.

    One set of bounds serves all groups: a bucket holds about 1/``buckets`` of all rows, so no group
    can exceed that inside a bucket.
    """
    step = math.isqrt(buckets)
    fractions = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    value = F.col(order).cast("double")
    found = df.agg(F.array_distinct(F.percentile_approx(value, fractions, F.lit(20 * buckets))).alias("b"))
    # Every step-th bound first, then the bounds in between: 2 * step comparisons per row, not step * step.
    coarse = f"transform(sequence(1, size(b) div {step}), i -> b[i * {step} - 1])"
    coarse = f"CASE WHEN size(b) < {step} THEN array() ELSE {coarse} END"
    bounds = found.select(F.expr(f"named_struct('b', b, 'c', {coarse})").alias("s"))
    placed = df.withColumn("_bounds", bounds.scalar()).withColumn("_v", value)
    placed = placed.withColumn("_skip", F.expr(f"{step} * size(filter(_bounds.c, x -> x < _v))"))
    below = F.expr(f"_skip + size(filter(slice(_bounds.b, _skip + 1, {step}), x -> x < _v))")
    return placed.withColumn(BUCKET, F.coalesce(below, F.lit(0))).drop("_bounds", "_v", "_skip")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums along ``order`` inside each group of a table already cut by ``value_buckets``.

    ``sums`` maps an output name to a SQL expression. (group, order) must be unique, as it is after
    aggregating to distinct values.
    """
    totals = df.groupBy(*by, BUCKET).agg(*[F.sum(F.expr(e)).alias(f"_o_{n}") for n, e in sums.items()])
    way = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = W.partitionBy(*by).orderBy(way).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, BUCKET, *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    step = F.col(order).desc() if descending else F.col(order).asc()
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(*by, BUCKET).orderBy(step).rowsBetween(W.unboundedPreceding, last)
    joined = null_safe_join(df, offsets, [*by, BUCKET])
    out = joined.withColumns(
        {
            n: F.col(f"_o_{n}") + F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0))
            for n, e in sums.items()
        }
    )
    return out.drop(*[f"_o_{n}" for n in sums])
