"""Every query with SQL against DuckDB on the smallest tables; queries without SQL run and keep their columns."""

from __future__ import annotations

import pytest
from conftest import SMALL

from compare import rows, same
from loomgraph.plans import registry

SLOW = {"rule_engine", "simulated_rounds", "acyclic_edges", "modularity_tiers"}  # tested on small graphs


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows(got), rows(want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
