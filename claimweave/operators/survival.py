"""Kaplan-Meier curves, life tables and log-rank tests from per-time tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from claimweave.functions.tails import Z95, chi2_tail
from claimweave.operators.ordered import BUCKET, running_sums, value_buckets
from claimweave.session import held


def kaplan_meier(
    df: DataFrame, time: str, event: str, by: Sequence[str] = (), weight: str | None = None, robust: bool = False
) -> DataFrame:
    """Product-limit curve per group: one row per distinct time.

    Persons are first summed to distinct times; risk sets and the product over times are running sums
    of that much smaller table. The standard error is Greenwood's, limits are on the log scale. With
    weights all counts are sums of weights.

    ``robust`` takes the infinitesimal jackknife instead, the right one for sampling or propensity weights: the sum of
    squared weighted influences of persons on the log curve. A person's influence is the sum of d / (r (r - d)) up to t
    or their own time, less 1 / (r - d) at their own event; so those still at risk share one value, and those gone
    add a running sum. Rows are persons: no clusters.
    """
    keys = list(by)
    data = df.dropna(subset=[time, event, *by, *([weight] if weight else [])])
    w = F.col(weight) if weight else F.lit(1)
    hit = F.col(event) == 1
    sums = [F.sum(w).alias("_n"), F.sum(F.when(hit, w).otherwise(w * 0)).alias("n_event")]
    if robust:
        square = w.cast("double") * w
        sums += [F.sum(square).alias("_w2"), F.sum(F.when(hit, square).otherwise(F.lit(0.0))).alias("_e2")]
    times = data.groupBy(*keys, F.col(time).cast("double").alias("time")).agg(*sums)
    totals = {"n_risk": "_n"} | ({"_after": "_w2"} if robust else {})
    risk = running_sums(held(value_buckets(held(times), "time")), keys, "time", totals, descending=True)
    steps = risk.withColumns(
        {
            "_last": F.expr("n_event > 0 AND n_risk - n_event <= 1e-12 * n_risk"),
            "n_censor": F.col("_n") - F.col("n_event"),
        }
    )
    curve = running_sums(
        steps,
        keys,
        "time",
        {
            "_log": "CASE WHEN NOT _last THEN log1p(-n_event / n_risk) ELSE 0D END",
            "_gw": "CASE WHEN NOT _last THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0D END",
            "_zero": "CAST(_last AS INT)",
        },
    )
    variance = F.col("_gw")
    if robust:
        gone = "CASE WHEN _last THEN 0D ELSE (_w2 - _e2) * pow(_gw, 2) + _e2 * pow(_gw - 1 / (n_risk - n_event), 2) END"
        curve = running_sums(curve, keys, "time", {"_gone": gone})
        variance = F.col("_gone") + F.pow("_gw", F.lit(2)) * (F.col("_after") - F.col("_w2"))
    surv = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp("_log"))
    half = Z95 * F.sqrt(variance)
    return curve.select(
        *by,
        "time",
        "n_risk",
        "n_event",
        "n_censor",
        surv.alias("surv"),
        F.when(F.col("_zero") == 0, surv * F.sqrt(variance)).alias("std_err"),
        F.when(F.col("_zero") == 0, F.exp(F.col("_log") - half)).alias("lower"),
        F.when(F.col("_zero") == 0, F.least(F.exp(F.col("_log") + half), F.lit(1.0))).alias("upper"),
    )


def life_table(
    km: DataFrame, times: Sequence[float], by: Sequence[str] = (), extend: bool = False
) -> DataFrame:
    """Curve read at fixed times: at risk at or after t, events up to t, survival at t.

    Times beyond a group's last observation are left out unless ``extend`` is set, as it is for the
    numbers-at-risk table under a plot.
    """
    at = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("at")
    past, ahead = F.col("time") <= F.col("at"), F.col("time") >= F.col("at")
    size = F.col("n_event") + F.col("n_censor")
    read = km.select("*", at).groupBy(*by, "at").agg(
        F.coalesce(F.sum(F.when(ahead, size)), F.lit(0)).alias("n_risk"),
        F.coalesce(F.sum(F.when(past, F.col("n_event"))), F.lit(0)).alias("cum_event"),
        F.coalesce(F.min(F.when(past, F.col("surv"))), F.lit(1.0)).alias("surv"),
        F.max("time").alias("_last"),
    )
    kept = read if extend else read.filter(F.col("at") <= F.col("_last"))
    return kept.select(*by, F.col("at").alias("time"), "n_risk", "cum_event", "surv")


def group_levels(df: DataFrame, by: str) -> list:
    """Levels of a grouping column."""
    return [r[0] for r in df.select(by).dropna().distinct().orderBy(by).collect()]


# Event times in one range of the running sums of the log-rank test.
_RANGE = 4096


def logrank(
    df: DataFrame, time: str, event: str, by: str, levels: Sequence[object] | None = None
) -> DataFrame:
    """Log-rank test of equal survival in k groups, one row per group with the global test on each.

    Times become numbers of event times (a censored person counts up to the last event time before), so that what
    is at risk changes at whole numbers only. Tables are long, one row per (event time, group). With c(t) the
    hypergeometric variance per pair at risk and C its running sum, two groups' covariance is minus the sum of
    C(min(Ti, Tj)) over pairs of persons; it is found from C, the persons of one group per time and the risk set of
    the other at that time, so rows are never paired within a time. The driver holds the k x k covariance. Groups
    that expect no events take no part in the degrees of freedom.
    """
    groups = list(levels) if levels is not None else group_levels(df, by)
    k = len(groups)
    if k < 2:
        raise ValueError("at least two groups are needed")
    spark = df.sparkSession
    known = spark.createDataFrame(list(enumerate(groups)), f"_g int, _by {df.schema[by].dataType.simpleString()}")
    counts = (
        df.dropna(subset=[time, event, by])
        .groupBy(F.col(by).alias("_by"), F.col(time).cast("double").alias("time"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("d"))
        .join(known, "_by")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    times = value_buckets(counts.groupBy("time").agg(F.sum("d").alias("d")), "time")
    nth = running_sums(times, [], "time", {"e": "CAST(d > 0 AS LONG)"}).select("time", "e")
    cells = counts.join(nth, "time").groupBy("e", "_g").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    cells, dense = cells.persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        last = cells.agg(F.max("e")).first()[0] or 0
        # Every event time with every group, by unrolling the list of groups.
        grid = spark.range(1, last + 1).select(F.col("id").alias("e"), F.explode(F.array(*map(F.lit, range(k)))).alias("_g"))
        dense = grid.join(cells, ["e", "_g"], "left").fillna(0, ["n", "d"]).withColumn(BUCKET, F.expr(f"e div {_RANGE}"))
        dense = running_sums(dense, ["_g"], "e", {"r": "n"}, descending=True).persist(StorageLevel.MEMORY_AND_DISK)
        both = dense.groupBy("e", BUCKET).agg(F.sum("d").alias("_d"), F.sum("r").alias("_r"))
        both = both.withColumn("s", F.expr("CASE WHEN _r > 1 THEN _d * (_r - _d) / (_r - 1) ELSE 0D END"))
        sums = dense.join(both, "e").groupBy("_g").agg(
            F.expr("sum(_d * r / _r)").alias("expected"),
            F.expr("sum(s * (r / _r) * (1 - r / _r))").alias("variance"),
        )
        totals = cells.groupBy("_g").agg(F.sum("n").alias("n"), F.sum("d").alias("observed"))
        found = {r["_g"]: r for r in totals.join(sums, "_g", "left").collect()}
        value = lambda g, c: float(found[g][c] or 0) if g in found else 0.0
        observed, expected, variance = (
            np.array([value(g, c) for g in range(k)]) for c in ("observed", "expected", "variance")
        )
        cov = np.diag(variance)
        tested = np.flatnonzero(expected > 0)
        if len(tested) > 2:
            own = cells.filter("e > 0").select("e", F.col("_g").alias("g"), F.col("n").alias("m"))
            c = running_sums(both, [], "e", {"c": "s / _r / _r"}).select("e", "c")
            pairs = own.join(dense.select("e", "_g", "n", "r").join(c, "e"), "e").filter("g <> _g").groupBy("g", "_g").agg(
                F.expr("sum(m * c * r)").alias("later"), F.expr("sum(m * c * n)").alias("same")
            )
            for row in pairs.collect():
                # Pairs with one's time not after the other's, from both sides; equal times were counted twice.
                cov[row["g"], row["_g"]] -= row["later"] - row["same"] / 2
                cov[row["_g"], row["g"]] -= row["later"] - row["same"] / 2
    finally:
        for table in (dense, cells, counts):
            if table is not None:
                table.unpersist()
    chisq, free = 0.0, max(len(tested) - 1, 0)
    if free:
        gap, block = (observed - expected)[tested[:-1]], cov[np.ix_(tested[:-1], tested[:-1])]
        chisq = float(gap @ np.linalg.pinv(block, hermitian=True) @ gap)
    p = chi2_tail(chisq, free) if free else float("nan")
    rows = [
        (str(g), int(value(i, "n")), int(observed[i]), float(expected[i]), float(variance[i]), chisq, free, p)
        for i, g in enumerate(groups)
    ]
    schema = (
        "level string, n long, observed long, expected double, variance double, "
        "chisq double, df int, p_value double"
    )
    return spark.createDataFrame(rows, schema)


def concordance(
    df: DataFrame, time: str, event: str, score: str, strata: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Share of comparable pairs in which the person with the earlier event has the higher score.

    No pairs are formed. Scores become ranks; two different ranks first differ at one binary digit, so
    every pair is counted at exactly one (digit, leading digits) group, from the event's side as events
    times those still at risk later on the other side. Work grows with persons times digits. Equal scores
    count one half, events at equal times are not compared.
    """
    keys = list(strata)
    w = F.col(weight) if weight else F.lit(1)
    rows = df.dropna(subset=[time, event, score, *keys, *([weight] if weight else [])])
    cells = held(
        rows.groupBy(*keys, F.col(time).cast("double").alias("_t"), F.col(score).cast("double").alias("_s")).agg(
            F.sum(w).alias("n"), F.sum(F.when(F.col(event) == 1, w).otherwise(w * 0)).alias("d")
        )
    )
    scores = held(value_buckets(cells.select("_s").distinct(), "_s"))
    digits = max(scores.count() - 1, 1).bit_length()
    ranks = running_sums(scores, [], "_s", {"_k": "1"}, inclusive=False).select("_s", F.col("_k").cast("long").alias("_k"))
    # Level -1 groups equal scores; level l >= 0 compares digit l below equal leading digits.
    spread = cells.join(ranks, "_s").select(
        *keys, "_t", "n", "d", "_k", F.explode(F.sequence(F.lit(-1), F.lit(digits - 1))).alias("_level")
    )
    spread = spread.withColumns(
        {
            "_group": F.expr("shiftright(_k, _level + 1)"),
            "_high": F.expr("CASE WHEN _level >= 0 THEN shiftright(_k, greatest(_level, 0)) & 1 ELSE 0 END = 1"),
        }
    )
    sides = {
        f"{c}{i}": F.sum(F.when(F.col("_high") if i else ~F.col("_high"), F.col(c)).otherwise(F.col(c) * 0))
        for c in "nd" for i in (0, 1)
    }
    group = [*keys, "_level", "_group"]
    tree = held(spread.groupBy(*group, "_t").agg(*[v.alias(k) for k, v in sides.items()]))
    later = running_sums(
        held(value_buckets(tree, "_t")), group, "_t", {"l0": "n0", "l1": "n1"}, descending=True, inclusive=False
    )
    low, high = F.expr("l0 + n0 - d0"), F.expr("l1 + n1 - d1")
    counts = later.agg(
        F.sum(F.col("d1") * low).alias("concordant"),
        F.sum(F.col("d0") * high).alias("discordant"),
        F.sum(F.when(F.col("_level") == -1, F.col("d0") * low).otherwise(F.lit(0))).alias("tied_score"),
    )
    total = F.col("concordant") + F.col("discordant") + F.col("tied_score")
    share = F.try_divide(F.col("concordant") + F.col("tied_score") / 2, total)
    return counts.withColumn("concordance", share)
