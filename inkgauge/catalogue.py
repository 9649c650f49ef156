"""All queries of the library and their SQL twins."""

from __future__ import annotations

from .plans import feature_queries, metric_queries, model_queries, page_queries, portrait, profile_queries, risk_queries, service_queries, time_queries

PLANS = (risk_queries, service_queries, profile_queries, feature_queries, metric_queries, model_queries, page_queries, portrait, time_queries)


def queries() -> dict:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
