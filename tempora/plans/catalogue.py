"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from tempora.plans import analysis_queries, asset_queries, ema_queries, feature_queries, indicator_queries, metric_queries, model_queries, monitor_queries, recursive_queries, relational_queries, report_queries, tracking_queries

_FAMILIES = (indicator_queries, feature_queries, recursive_queries, relational_queries, metric_queries, asset_queries, monitor_queries, model_queries, report_queries, tracking_queries, ema_queries, analysis_queries)
QUERIES = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLE_SQL = {name: text for family in _FAMILIES for name, text in family.ORACLE_SQL.items()}
