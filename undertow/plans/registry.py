"""Named queries over the driver's tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from undertow.plans import file_queries, graph_queries, label_queries, model_queries

MODULES = (graph_queries, label_queries, file_queries, model_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
