"""All registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import feature_queries, model_queries, prediction_queries, report_queries, similarity_queries

_MODULES = [report_queries, feature_queries, prediction_queries, similarity_queries, model_queries]


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Some texts list the stop words, so they are built on demand."""
    return {name: text() if callable(text) else text for module in _MODULES for name, text in module.SQL.items()}
