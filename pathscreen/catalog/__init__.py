"""Named queries over the operators."""
from __future__ import annotations

import importlib

_MODULES = ("metric_queries", "benchmark_queries", "trade_queries", "score_queries", "match_queries", "mapping_queries", "source_queries", "loader_queries", "tradelog_queries")


def _load():
    from pathscreen.catalog import registry
    for m in _MODULES:
        importlib.import_module(f"pathscreen.catalog.{m}")
    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
