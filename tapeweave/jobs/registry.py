"""All registered queries of this package but the text operators'."""

from __future__ import annotations

from . import bar_queries, stream_queries, study_queries, trade_queries

_PARTS = [bar_queries, trade_queries, study_queries, stream_queries]


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}


def flagship(spark, sf_dir):
    """Hourly bars, crossing averages, stops and costs: the figures of a backtest by symbol."""
    return queries()["x1_backtest_metrics"](spark, sf_dir)
