"""Look-back disease history from coded claims."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from claimweave.functions.clean import flag
from claimweave.operators.cohort import records_in_window
from claimweave.operators.codes import label_codes


def long_codes(
    sources: Sequence[tuple[DataFrame, str, Sequence[str], int]],
    by: str,
    date_name: str = "func_date",
    code_name: str = "code",
) -> DataFrame:
    """Stack ``(table, date column, code columns, weight)`` sources to one row per code slot."""
    parts = []
    for df, date, cols, weight in sources:
        slim = df.select(F.col(by), F.col(date).alias(date_name), *[F.col(c).cast("string").alias(c) for c in cols])
        long = slim.unpivot([by, date_name], list(cols), "slot", code_name)
        parts.append(long.withColumn("weight", F.lit(weight)))
    return reduce(DataFrame.unionByName, parts)


def history(
    sources: Sequence[tuple[DataFrame, str, Sequence[str], int]],
    cohort: DataFrame,
    by: str,
    index: str,
    labels: Sequence[tuple[str, str]],
    days: int = 90,
    dedupe: str = "dx",
    min_weight: int = 2,
    prefix: str = "",
) -> DataFrame:
    """0/1 history per disease for persons whose weighted record days reach ``min_weight``.

    ``dedupe='dx'`` counts a disease once per person-day, ``'code'`` each distinct code once per
    person-day. Codes of no interest and records of other persons or days go first, by a join on the
    person, so what is shuffled grows with the cohort; the sums after it need no other partitioning.
    """
    if dedupe not in ("dx", "code"):
        raise ValueError("dedupe is 'dx' or 'code'")
    coded = label_codes(long_codes(sources, by), "code", labels, prefix)
    unit = ["dx"] if dedupe == "dx" else ["code", "dx"]
    own = records_in_window(coded, cohort, by, "func_date", index, days)
    daily = own.groupBy(by, "func_date", *unit).agg(F.max("weight").alias("weight"))
    names = [prefix + name for name, _ in labels]
    totals = daily.groupBy(by).agg(*[F.sum(F.when(F.col("dx") == n, F.col("weight"))).alias(n) for n in names])
    flags = totals.select(by, *[flag(F.col(n) >= min_weight).alias(n) for n in names])
    return flags.filter(reduce(lambda a, b: a | b, [F.col(n) == 1 for n in names]))
