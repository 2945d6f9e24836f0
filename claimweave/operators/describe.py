"""Frequencies, summaries, Table 1, standardised differences and incidence rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.operators.ordered import null_safe_join, running_sums, value_buckets
from claimweave.session import held


def frequency(df: DataFrame, columns: str | Sequence[str], keep_null: bool = False) -> DataFrame:
    """Counts per value; missing values are left out unless asked for."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    data = df if keep_null else df.dropna(subset=cols)
    return data.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[object], prefix: str = "n_") -> DataFrame:
    """Two-way counts with one column per listed level."""
    counts = [F.count_if(F.col(columns) == F.lit(v)).alias(f"{prefix}{v}") for v in levels]
    return df.dropna(subset=[rows, columns]).groupBy(rows).agg(*counts)


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per (group, variable, value) of numeric columns in long form."""
    slim = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return (
        slim.unpivot(list(by), list(columns), "variable", "value")
        .groupBy(*by, "variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def summarise_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Six-number summary, mean and SD from value counts.

    Quartiles are exact and interpolated between neighbours. They are read off running counts over
    distinct values, so no group's values are gathered in one place.
    """
    keys = [*by, "variable"]
    counts = held(counts)
    n = F.col("n")
    totals = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("n_missing"),
        (F.sum(F.col("value") * n) / F.sum(F.when(F.col("value").isNotNull(), n))).alias("mean"),
    )
    known = held(value_buckets(counts.filter(F.col("value").isNotNull()), "value"))
    placed = null_safe_join(totals, running_sums(known, keys, "value", {"_cum": "n"}), keys, "left")

    def quantile(p: float) -> Column:
        at = (F.col("count") - 1) * F.lit(p)
        lo = F.min(F.when(F.col("_cum") > F.floor(at), F.col("value")))
        hi = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("value")))
        return lo + (hi - lo) * F.max(at - F.floor(at))

    squares = F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2))
    return placed.groupBy(*keys, "count", "n_missing", "mean").agg(
        F.sqrt(F.try_divide(squares, F.max(F.col("count")) - 1)).alias("sd"),
        F.min("value").alias("min"),
        quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q3"),
        F.max("value").alias("max"),
    ).withColumnRenamed("count", "n")


def six_number(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Summary of numeric columns, overall or per group."""
    return summarise_counts(value_counts(df, columns, by), by)


def means(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Group size and scaled means (``scale=100`` gives percentages of 0/1 columns)."""
    cols = [(F.avg(c) * scale).alias(c) for c in columns]
    count = F.count(F.lit(1)).alias("n")
    return df.groupBy(*by).agg(count, *cols) if by else df.agg(count, *cols)


def balance(before: DataFrame, after: DataFrame, by: str, props: Sequence[str]) -> DataFrame:
    """Group sizes and percentages before and after matching."""
    return means(before, props, [by], 100.0).withColumn("phase", F.lit("before")).unionByName(
        means(after, props, [by], 100.0).withColumn("phase", F.lit("after"))
    )


def histogram(
    df: DataFrame, column: str, by: Sequence[str] = (), start: float = 0.0, stop: float = 1.0, width: float = 0.05
) -> DataFrame:
    """Counts per right-closed bin of fixed width; the lowest break belongs to the first bin."""
    bins = round((stop - start) / width)
    x = F.col(column)
    index = F.greatest(F.ceil(F.round((x - start) / width, 9)), F.lit(1)).cast("int")
    inside = df.filter(x.isNotNull() & (x >= start) & (index <= bins))
    return (
        inside.groupBy(*by, index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "bin_lo": F.round(F.lit(start) + (F.col("bin") - 1) * width, 9),
                "bin_hi": F.round(F.lit(start) + F.col("bin") * width, 9),
            }
        )
    )


def table_one(
    df: DataFrame,
    strat: str,
    cat: Sequence[str],
    cont: Sequence[str],
    stats: Sequence[str] = ("n", "pct", "mean", "sd", "median"),
    overall: str = "Overall",
) -> DataFrame:
    """Stratified Table 1 in long form: one row per variable, level, stratum and statistic.

    Categorical percentages are within the stratum and over known levels. The overall column is added up
    from the stratum counts, so the data are scanned once per variable type.
    """
    parts = []
    stratum = F.col(strat).cast("string").alias("stratum")
    if cat:
        slim = df.select(stratum, *[F.col(c).cast("string").alias(c) for c in cat])
        counts = (
            slim.unpivot(["stratum"], list(cat), "variable", "level")
            .filter(F.col("level").isNotNull())
            .groupBy("stratum", "variable", "level")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        both = _with_overall(counts, ["variable", "level"], overall)
        size = both.groupBy("stratum", "variable").agg(F.sum("n").alias("_of"))
        rates = both.join(size, ["stratum", "variable"]).withColumn("pct", F.col("n") / F.col("_of") * 100)
        parts.append(_long_stats(rates, "categorical", [s for s in stats if s in ("n", "pct")]))
    if cont:
        counts = value_counts(df.withColumn("stratum", stratum), cont, ["stratum"])
        both = _with_overall(counts, ["variable", "value"], overall)
        summary = summarise_counts(both, ["stratum"]).withColumn("level", F.lit(None).cast("string"))
        wanted = [s for s in stats if s in ("mean", "sd", "median", "q1", "q3", "min", "max", "n_missing")]
        parts.append(_long_stats(summary, "continuous", wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_overall(counts: DataFrame, keys: Sequence[str], overall: str) -> DataFrame:
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("stratum", F.lit(overall))
    return counts.filter(F.col("stratum").isNotNull()).unionByName(total)


def _long_stats(df: DataFrame, section: str, stats: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])
    return df.select(F.lit(section).alias("section"), "variable", "level", "stratum", F.inline(rows))


def baseline_smd(
    df: DataFrame, treat: str, cont: Sequence[str], binary: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Group means, SDs and absolute standardised differences of a 0/1 treatment, optionally weighted.

    The weighted variance of a continuous variable is scaled by n / (n - 1). Continuous values are summed as differences
    from their group's mean, so a large mean costs no digits; a group of one value has standard deviation 0, and where
    both groups have, there is no standardised difference.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    first = [F.lit(1)]
    for v in cont:
        for g in (0, 1):
            own = F.when(F.col(treat) == g, F.col(v).cast("double"))
            first += [F.avg(own).alias(f"{v}_m{g}"), (F.min(own) == F.max(own)).alias(f"{v}_one{g}"), F.min(own).alias(f"{v}_least{g}")]
    known = df.agg(*first).first()
    aggs, rows = [], []
    for v in [*cont, *binary]:
        shift = [0.0, 0.0]
        if v in cont:
            shift = [(known[f"{v}_least{g}"] if known[f"{v}_one{g}"] else known[f"{v}_m{g}"]) or 0.0 for g in (0, 1)]
        for g in (0, 1):
            x = F.col(v).cast("double") - F.lit(shift[g])
            here = (F.col(treat) == g) & x.isNotNull()
            aggs += [
                F.count_if(here).alias(f"{v}_n{g}"),
                F.sum(F.when(here, w)).alias(f"{v}_w{g}"),
                F.sum(F.when(here, w * x)).alias(f"{v}_s{g}"),
                F.sum(F.when(here, w * x * x)).alias(f"{v}_q{g}"),
            ]
        mean = {g: F.try_divide(F.col(f"{v}_s{g}"), F.col(f"{v}_w{g}")) for g in (0, 1)}  # less the shift
        var = {}
        for g in (0, 1):
            if v in binary:
                var[g] = mean[g] * (1 - mean[g])
            else:
                raw = F.try_divide(F.col(f"{v}_q{g}"), F.col(f"{v}_w{g}")) - mean[g] * mean[g]
                n = F.col(f"{v}_n{g}").cast("double")
                var[g] = raw * F.try_divide(n, n - 1)
        rows.append(
            F.struct(
                F.lit(v).alias("variable"),
                F.lit("binary" if v in binary else "continuous").alias("kind"),
                F.col(f"{v}_n0").alias("n_0"),
                F.col(f"{v}_n1").alias("n_1"),
                (mean[0] + F.lit(shift[0])).alias("mean_0"),
                (mean[1] + F.lit(shift[1])).alias("mean_1"),
                F.sqrt(var[0]).alias("sd_0"),
                F.sqrt(var[1]).alias("sd_1"),
                F.try_divide(F.abs(mean[1] - mean[0] + F.lit(shift[1] - shift[0])), F.sqrt((var[1] + var[0]) / 2)).alias("smd"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def incidence(
    df: DataFrame,
    time: str,
    event: str,
    by: Sequence[str],
    per: float,
    weight: str | None = None,
) -> DataFrame:
    """Persons, events, follow-up and events per ``per`` units of follow-up, optionally weighted."""
    w = F.col(weight) if weight else F.lit(1)
    n = F.sum(w) if weight else F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("tot_n"),
        F.sum(w * F.col(event)).alias("tot_event"),
        F.sum(w * F.col(time)).alias("tot_time"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
        (F.try_divide(F.sum(w * F.col(event)), F.sum(w * F.col(time))) * per).alias("rate"),
    )


def compare_designs(results: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the same result of several designs under a ``design`` column."""
    out: DataFrame | None = None
    for name, df in results.items():
        part = df.withColumn("design", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no results to compare")
    return out
