"""Propensity-score study: crude, matched and weighted comparisons of one treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import describe, matching, survival, weights
from claimweave.operators.cox import cox
from claimweave.operators.fits import Fit

# Covariates, curve times and histogram bins of the study.
CONTINUOUS = ("age",)
BINARY = ("male", "htn", "dm", "hyperlipidemia", "malignancy")
CURVE_TIMES = (0.0, 0.5, 1.0, 1.5, 2.0)


def designs(
    df: DataFrame,
    id: str,
    treat: str,
    covariates: Sequence[str] = ("male", "age", "dm", "htn", "hyperlipidemia", "malignancy"),
    caliper_sd: float = 0.2,
    seed: int = 0,
) -> tuple[dict[str, DataFrame], Fit]:
    """The crude, matched and weighted data sets, and the propensity model."""
    scored, model = weights.propensity(df, treat, covariates)
    pairs = matching.ps_match(scored, id, treat, "ps", caliper_sd, seed=seed)
    matched = scored.join(pairs.select(id, "pair_id"), id)
    weighted = weights.iptw(scored, treat, "ps")
    return {"crude": scored, "matched": matched, "weighted": weighted}, model


def compare(
    sets: dict[str, DataFrame],
    treat: str,
    time: str,
    event: str,
    cont: Sequence[str] = CONTINUOUS,
    binary: Sequence[str] = BINARY,
    times: Sequence[float] = CURVE_TIMES,
) -> dict[str, DataFrame]:
    """Baseline, incidence, curves, risk tables, log-rank tests and Cox estimates of the three designs.

    The log-rank test of the weighted design is the unweighted test.
    """
    w = {"crude": None, "matched": None, "weighted": "iptw"}
    adjust = [treat, *[c for c in (*binary, *cont)]]
    curves = {n: survival.kaplan_meier(d, time, event, [treat], w[n]) for n, d in sets.items()}
    fits = {
        "crude": cox(sets["crude"], time, event, adjust),
        "matched": cox(sets["matched"], time, event, [treat], strata=["pair_id"]),
        "weighted": cox(sets["weighted"], time, event, [treat], weight="iptw"),
    }
    stack = describe.compare_designs
    return {
        "baseline": stack({n: describe.baseline_smd(d, treat, cont, binary, w[n]) for n, d in sets.items()}),
        "incidence": stack({n: describe.incidence(d, time, event, [treat], 100, w[n]) for n, d in sets.items()}),
        "km": stack(curves),
        "risk_table": stack({n: survival.life_table(c, times, [treat], extend=True) for n, c in curves.items()}),
        "logrank": stack({n: survival.logrank(d, time, event, treat, [0, 1]) for n, d in sets.items()}),
        "cox": stack({n: f.tidy() for n, f in fits.items()}),
        "ps_histogram": describe.histogram(sets["crude"].filter(F.col("ps").isNotNull()), "ps", [treat]),
    }
