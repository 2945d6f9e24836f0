"""Exact frequency matching and nearest-neighbour propensity-score matching."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.operators.ordered import BUCKET, hash_buckets, null_safe_join, random_rank, running_sums, value_buckets
from claimweave.session import ensure_checkpoint_dir


def frequency_match(
    df: DataFrame,
    case: str,
    strata: Sequence[str],
    ratio: int,
    seed: int,
    id: str,
    set_name: str = "gg",
) -> DataFrame:
    """1:r matching inside exact strata, in seeded pseudo-random order.

    A stratum with enough controls keeps all its cases; otherwise it keeps as many cases as its controls
    can serve. Ranks come from hash buckets, so a stratum is never sorted by one task, and buckets past
    the last wanted control are dropped before the shuffle.
    """
    rows = hash_buckets(df.filter(F.col(case).isin(0, 1)), [id], seed)
    keys = [*strata, case, BUCKET]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*strata, case).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*strata)
    counts = counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_cases": F.sum(F.when(F.col(case) == 1, F.col("_n")).otherwise(0)).over(whole),
            "_controls": F.sum(F.when(F.col(case) == 0, F.col("_n")).otherwise(0)).over(whole),
        }
    )
    enough = F.col("_controls") >= F.col("_cases") * ratio
    sets = F.when(enough, F.col("_cases")).otherwise(F.floor(F.col("_controls") / ratio))
    limit = F.when(F.col(case) == 1, sets).otherwise(sets * ratio)
    wanted = counts.withColumn("_limit", limit).filter(F.col("_before") < F.col("_limit"))
    inside = W.partitionBy(*keys).orderBy("_hash", id)
    ranked = null_safe_join(rows, wanted.select(*keys, "_before", "_limit"), keys).withColumn(
        "_q", F.col("_before") + F.row_number().over(inside)
    )
    block = F.when(F.col(case) == 1, F.col("_q")).otherwise(F.ceil(F.col("_q") / ratio))
    return (
        ranked.filter(F.col("_q") <= F.col("_limit"))
        .withColumn(set_name, F.concat_ws("-", *[F.col(c).cast("string") for c in strata], block.cast("string")))
        .drop("_hash", BUCKET, "_before", "_limit", "_q")
    )


_FLOW = "seg int, t_ps double, c_ps double, t_from long, c_from long, k long"


class _Piece(NamedTuple):
    """Treated scores from ``lo`` to ``hi`` and how many units they are."""

    lo: float
    hi: float
    units: int


def _nearest_free(pdf: pd.DataFrame, caliper: float) -> pd.DataFrame:
    """Serve the treated values of one segment, highest score first, from the nearest free controls.

    Rows are distinct scores with the number of treated, of controls and of controls already used. Two
    arrays of links lead from a score to the nearest score above or below that still has controls.
    """
    pdf = pdf.groupby("ps", as_index=False).agg(n_t=("n_t", "sum"), n_c=("n_c", "sum"), used=("used", "sum"))
    pdf = pdf.sort_values("ps", ignore_index=True)
    ps, need, used = pdf["ps"].to_numpy(), pdf["n_t"].to_numpy(), pdf["used"].to_numpy().copy()
    free = pdf["n_c"].to_numpy() - used
    size = len(ps)
    up, down = list(range(size + 1)), list(range(size + 1))  # down is shifted by one: 0 means none

    def find(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    for i in np.flatnonzero(free <= 0):
        up[i], down[i + 1] = i + 1, i
    flows = []
    for i in np.flatnonzero(need > 0)[::-1]:
        left, given = int(need[i]), 0
        while left > 0:
            above, below = find(up, i), find(down, i + 1) - 1
            gap_above = ps[above] - ps[i] if above < size else math.inf
            gap_below = ps[i] - ps[below] if below >= 0 else math.inf
            j, gap = (above, gap_above) if gap_above <= gap_below else (below, gap_below)
            if not math.isfinite(gap) or gap > caliper:
                break
            take = min(left, int(free[j]))
            flows.append((ps[i], ps[j], given, int(used[j]), take))
            left, given = left - take, given + take
            used[j] += take
            free[j] -= take
            if free[j] == 0:
                up[j], down[j + 1] = j + 1, j
    return pd.DataFrame(flows, columns=["t_ps", "c_ps", "t_from", "c_from", "k"])


def _segment_flows(groups: DataFrame, caliper: float) -> DataFrame:
    def serve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _nearest_free(pdf, caliper)
        out.insert(0, "seg", key[0])
        return out

    return groups.groupBy("seg").applyInPandas(serve, _FLOW)


def _within(pieces: list[tuple], inside: Callable[[Column], Column]) -> Column:
    """A row for each piece that a row lies inside of; a piece is (first, last, lo, hi). A wave has few, so no join is needed."""
    kinds = (("first", "long"), ("last", "long"), ("lo", "double"), ("hi", "double"))
    listed = [F.struct(F.lit(i).alias("seg"), *[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(p, kinds)]) for i, p in enumerate(pieces)]
    return F.explode(F.transform(F.filter(F.array(*listed), inside), lambda p: p["seg"])).alias("seg")


def _asking(ranked: DataFrame, pieces: list[_Piece]) -> DataFrame:
    """Treated scores of the pieces of a wave."""
    own = _within([(0, 0, p.lo, p.hi) for p in pieces], lambda p: F.col("ps").between(p["lo"], p["hi"]))
    return ranked.filter("n_t > 0").select(own, "ps", "n_t", "free", "above")


def _views(ranked: DataFrame, pieces: list[_Piece], ends: list[tuple[int, int]], caliper: float) -> DataFrame:
    """Controls that the pieces of a wave can need: (seg, ps, n_c, used).

    ``ranked(ps, n_c, used, free, above)`` holds free units and those at or above each score; ``ends`` the units above a
    piece's treated, and those down to their lowest. The pieces down to a piece's own can use as many units as they have
    treated. A control is in view if fewer free units than that lie between it and the treated, within the caliper.
    """
    needs = np.cumsum([p.units for p in pieces]).tolist()
    bounds = [(max(over - n, 0), upto + n, p.lo, p.hi) for p, n, (over, upto) in zip(pieces, needs, ends)]
    far = lambda gap: F.nanvl(gap, F.lit(0.0)) > caliper
    inside = lambda p: (
        (F.col("above") - F.col("free") < p["last"]) & (F.col("above") > p["first"]) & ~far(F.col("ps") - p["hi"]) & ~far(p["lo"] - F.col("ps"))
    )
    return ranked.filter("free > 0").select(_within(bounds, inside), "ps", "n_c", "used")


def _solve_wave(treated: DataFrame, offered: DataFrame, segments: int, caliper: float) -> DataFrame:
    """Flows of the segments of one wave, served in order of ``seg``.

    All are solved at once from what the segments before them used in the last round, until nothing changes. The
    r-th segment is right after r rounds at the latest.
    """
    zero = F.lit(0).cast("long")
    asking = treated.select("seg", "ps", "n_t", zero.alias("n_c"), zero.alias("used"))
    if segments == 1:
        return _segment_flows(asking.unionByName(offered.select("seg", "ps", zero.alias("n_t"), "n_c", "used")), caliper).checkpoint()
    offered = offered.checkpoint()
    own = treated.sparkSession.createDataFrame([], "seg int, ps double, own long")
    before = W.partitionBy("ps").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    for _ in range(segments):
        state = offered.join(own, ["seg", "ps"], "left")
        used = F.least(F.col("used") + F.coalesce(F.sum("own").over(before), zero), F.col("n_c"))
        groups = asking.unionByName(state.select("seg", "ps", zero.alias("n_t"), "n_c", used.alias("used")))
        flows = _segment_flows(groups, caliper).checkpoint()
        now = flows.groupBy("seg", F.col("c_ps").alias("ps")).agg(F.sum("k").alias("now"))
        both = own.join(now, ["seg", "ps"], "full")
        if both.filter("NOT own <=> now").isEmpty():
            break
        own = now.withColumnRenamed("now", "own").checkpoint()
    return flows


def _heavy_flows(state: DataFrame, score: float, units: int, caliper: float) -> DataFrame:
    """Flows of one score with very many treated: its nearest free units, by running sums over the distance."""
    near = state.filter("free > 0").withColumn("_dist", F.abs(F.col("ps") - F.lit(score))).filter(F.col("_dist") <= caliper)
    near = near.checkpoint()
    rings = near.groupBy("_dist").agg(F.sum("free").alias("_f"))
    rings = running_sums(value_buckets(rings, "_dist"), [], "_dist", {"_inner": "_f"}, inclusive=False).select("_dist", "_inner")
    # At one distance lie at most two scores; the higher is taken first.
    pair = W.partitionBy("_dist").orderBy(F.col("ps").desc()).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("_inner") + F.coalesce(F.sum("free").over(pair), F.lit(0))
    taken = near.join(rings.filter(F.col("_inner") < units), "_dist").withColumn("t_from", first.cast("long"))
    return taken.filter(F.col("t_from") < units).select(
        F.lit(0).alias("seg"), F.lit(score).alias("t_ps"), F.col("ps").alias("c_ps"), "t_from", F.col("used").cast("long").alias("c_from"),
        F.least(F.col("free"), units - F.col("t_from")).cast("long").alias("k"),
    ).checkpoint()


def _pieces(placed: DataFrame, **keys: Column) -> list[_Piece]:
    """Ranges of treated scores with equal keys, from the top; one row for each reaches the driver."""
    found = placed.filter("n_t > 0").groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.min("ps").alias("lo"), F.max("ps").alias("hi"), F.sum("n_t").alias("units")
    )
    return [_Piece(r["lo"], r["hi"], r["units"]) for r in sorted(found.collect(), key=lambda r: [r[n] for n in keys])]


def _match_values(values: DataFrame, caliper: float, per_segment: int, wave: int) -> DataFrame:
    """Flows ``k`` treated of one score to controls of another, equal to the serial greedy rule.

    Treated are served from high to low, so a range of scores depends on higher ones only. Scores are cut from the top
    into pieces of about ``per_segment`` scores, treated and controlled, however many units they have. ``wave`` pieces are
    solved at a time; what they used is then settled. On either side a piece can use no more units than the treated of
    its wave down to its own, and none beyond the caliper, so that is all it needs to see. Pieces that would see too many
    scores wait for a later wave; the first of a wave is then cut again, into pieces of less than twice ``per_segment``
    treated units, which see few scores, and single scores with more. If such a score would see too many, it is a step of its
    own, without any group. So no group grows with the data, also where controls are exhausted over a long range of
    scores, and the number of steps grows with distinct scores, not with the persons who share them.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    zero = F.lit(0).cast("long")
    size = values.agg(F.count_if(F.col("n_t") > 0).alias("t"), F.count_if(F.col("n_c") > 0).alias("c")).first()
    if size["t"] + size["c"] <= per_segment:
        # All scores are one segment.
        every = values.select(F.lit(0).alias("seg"), "ps", "n_t", "n_c", zero.alias("used"))
        return _solve_wave(every, every.filter("n_c > 0"), 1, caliper)
    heavy = f"n_t > {per_segment}"
    costs = {
        "_scores": "CAST(n_t > 0 AS INT) + CAST(n_c > 0 AS INT)", "_units": f"CASE WHEN {heavy} THEN 0 ELSE n_t END", "_phase": f"CAST({heavy} AS INT)",
    }
    placed = running_sums(value_buckets(values, "ps"), [], "ps", costs, descending=True, inclusive=False).checkpoint()
    todo = _pieces(placed, part=F.floor(F.col("_scores") / per_segment))
    # Outside of its own scores, a piece of 2 * per_segment units sees 4 * per_segment others at most.
    most = (4 * wave + 2) * per_segment + 3
    settled = spark.createDataFrame([], "ps double, used long")
    done: list[DataFrame] = []
    ranked = None
    while todo:
        if ranked is None:
            state = placed.join(settled, "ps", "left").withColumn("used", F.coalesce("used", zero))
            state = state.withColumn("free", F.col("n_c") - F.col("used"))
            ranked = running_sums(state, [], "ps", {"above": "free"}, descending=True).checkpoint()
        step = todo[:wave]
        ends = _asking(ranked, step).groupBy("seg").agg(F.min(F.col("above") - F.col("free")).alias("over"), F.max("above").alias("upto"))
        ends = [(r["over"], r["upto"]) for r in sorted(ends.collect())]
        seen = {r["seg"]: r["count"] for r in _views(ranked, step, ends, caliper).groupBy("seg").count().collect()}
        wide = [i for i in range(len(step)) if seen.get(i, 0) > most]
        step = step[: wide[0]] if wide else step
        first = todo[0]
        if step:
            offered = _views(ranked, step, ends, caliper)
            flows = _solve_wave(_asking(ranked, step).select("seg", "ps", "n_t"), offered, len(step), caliper)
        elif first.lo < first.hi:
            # A heavy score closes a phase and is a piece of its own; light pieces do not reach across it.
            own = placed.filter(F.col("ps").between(first.lo, first.hi))
            todo[:1] = _pieces(own, phase=F.col("_phase"), heavy=F.expr(heavy), cut=F.floor(F.col("_units") / per_segment))
            continue
        else:
            step, flows = [first], _heavy_flows(ranked, first.hi, first.units, caliper)
        todo = todo[len(step) :]
        done.append(flows)
        used = flows.groupBy(F.col("c_ps").alias("ps")).agg(F.sum("k").alias("used"))
        settled = settled.unionByName(used).groupBy("ps").agg(F.sum("used").alias("used")).checkpoint()
        ranked = None
    out = spark.createDataFrame([], _FLOW)
    for flows in done:
        out = out.unionByName(flows)
    return out


def ps_match(
    df: DataFrame,
    id: str,
    treat: str,
    ps: str,
    caliper_sd: float | None = 0.2,
    caliper: float | None = None,
    seed: int = 0,
    per_segment: int = 20_000,
    wave: int = 16,
    chunk: int = 10_000,
) -> DataFrame:
    """1:1 nearest-neighbour matching without replacement, treated served in descending score.

    The caliper is ``caliper_sd`` sample standard deviations of the score, or ``caliper`` in score units.
    Persons with equal scores are interchangeable, so the greedy rule runs on distinct scores with counts
    and its result is expanded back to persons by rank. Returns two rows per pair: the columns ``id``,
    ``treat``, ``ps``, the ``pair_id`` (the treated person's id) and a unit weight. ``per_segment`` scores make one
    group of work, which sees about ``(4 * wave + 2) * per_segment`` controlled scores at most; results do not depend on either.
    """
    rows = df.select(F.col(id).alias("_id"), F.col(treat).alias("_t"), F.col(ps).cast("double").alias("ps"))
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.filter(F.col("_t").isin(0, 1) & F.col("ps").isNotNull()).checkpoint()  # read six times
    if caliper is None:
        caliper = math.inf
        if caliper_sd is not None:
            caliper = caliper_sd * (rows.agg(F.stddev_samp("ps")).first()[0] or 0.0)
    values = rows.groupBy("ps").agg(
        F.count_if(F.col("_t") == 1).alias("n_t"), F.count_if(F.col("_t") == 0).alias("n_c")
    )
    flows = _match_values(values.checkpoint(), caliper, per_segment, wave)
    # Flows to pairs in two steps, so that a flow of very many persons is spread before it is unrolled.
    starts = flows.select(
        "t_ps", "c_ps", "t_from", "c_from", "k",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(chunk).cast("long"))).alias("_at"),
    ).repartition("t_ps", "c_ps", "_at")
    unit = F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + chunk, F.col("k")) - 1))
    pairs = starts.select("t_ps", "c_ps", "t_from", "c_from", unit.alias("_i")).select(
        "t_ps",
        "c_ps",
        (F.col("t_from") + F.col("_i") + 1).alias("t_rank"),
        (F.col("c_from") + F.col("_i") + 1).alias("c_rank"),
    )
    ranked = random_rank(rows, ["ps", "_t"], ["_id"], seed)
    side = lambda t, p: ranked.filter(F.col("_t") == t).select(
        F.col("_id").alias(f"{p}_id"), F.col("ps").alias(f"{p}_ps"), F.col("rank").alias(f"{p}_rank")
    )
    linked = pairs.join(side(1, "t"), ["t_ps", "t_rank"]).join(side(0, "c"), ["c_ps", "c_rank"])
    both = F.array(
        *[
            F.struct(
                F.col(f"{p}_id").alias(id),
                F.col("t_id").alias("pair_id"),
                F.lit(t).alias(treat),
                F.col(f"{p}_ps").alias(ps),
                F.lit(1.0).alias("weight"),
            )
            for t, p in ((1, "t"), (0, "c"))
        ]
    )
    return linked.select(F.inline(both))
