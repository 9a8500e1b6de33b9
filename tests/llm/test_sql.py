"""The queries that SQL can express, against it."""

from __future__ import annotations

import os

import pytest

from tessera.llm import registry

from ..compare import connection, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    assert not difference(registry.QUERIES[name](spark, SF), connection(SF), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_it_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
