"""Registered queries by area."""

from __future__ import annotations

from demandlake.plans import backtest, coefficients, features, hierarchy, ingestion, model_input, modelling, retrieval  # noqa: F401
from demandlake.plans.registry import AS_OF, ORACLES, QUERIES, Query, complete


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: complete(sql, AS_OF.get(name)) for name, sql in ORACLES.items()}
