"""Every query that has SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same, database

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_query_matches_sql(spark, db, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith(("op", "pipeline"))))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "id", "score", "rank"]
    assert found.count() > 0
