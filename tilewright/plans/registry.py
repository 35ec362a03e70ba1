"""All registered queries of the slide, grid and annotation operators, with their SQL.

Each entry runs an operator over tables that are selected from the given ones (see ``fixtures``); the SQL is written
independently of the operator's own formulation wherever that is possible.
"""

from __future__ import annotations

from collections.abc import Callable

from . import file_queries, grid_queries, layer_queries, shape_queries, table_queries

GROUPS = (file_queries, grid_queries, layer_queries, shape_queries, table_queries)


def queries() -> dict[str, Callable]:
    return {name: run for group in GROUPS for name, (run, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
