"""Queries over the reference tables by name, and DuckDB SQL for their rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.bindings import Graph, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of a Graph as a query of its own name, with SQL over the same views."""

    def register(function: Callable[[Graph], DataFrame]):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = lambda spark, folder: function(Graph(spark, folder))
        if oracle is not None:
            ORACLE_SQL[key] = sql(oracle)
        return function

    return register


for _module in ("graph_queries", "claim_queries", "rule_queries", "text_queries", "entity_queries", "structure_queries", "dynamics_queries", "file_queries", "more_queries", "question_queries", "impact_queries", "read_queries"):
    importlib.import_module(f"loomgraph.plans.{_module}")
