"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from oracles import differences
from vidtables.jobs import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, QUERIES[name], ORACLES[name]) == ([], [], 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
