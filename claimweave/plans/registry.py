"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from claimweave.plans import queries_cohort, queries_statistics, queries_tables  # noqa: F401
from claimweave.plans.driver_tables import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
