"""Propensity scores and inverse-probability-of-treatment weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from claimweave.operators.fits import Fit
from claimweave.operators.regression import logistic, predict_probability


def propensity(df: DataFrame, treat: str, covariates: Sequence[str], name: str = "ps") -> tuple[DataFrame, Fit]:
    """Add the fitted probability of treatment; also return the model."""
    fit = logistic(df, treat, covariates)
    return predict_probability(df, fit, name), fit


def iptw(df: DataFrame, treat: str, ps: str, stabilised: bool = True, name: str = "iptw") -> DataFrame:
    """Inverse-probability weights; stabilised ones carry the marginal treatment prevalence."""
    t, p = F.col(treat), F.col(ps)
    share = df.agg(F.avg(treat).alias("share")).scalar() if stabilised else None
    top, bottom = (share, 1 - share) if stabilised else (F.lit(1.0), F.lit(1.0))
    return df.withColumn(name, t * top / p + (1 - t) * bottom / (1 - p))
