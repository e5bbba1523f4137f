"""The subpackage's queries against their SQL."""

import pytest

from checks.compare import differences, tables
from fairshare.llm.oracle import SQL
from fairshare.llm.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return tables("/root/testdata/sf0.001")


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_its_sql(spark, sf_dir, connection, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(ours, connection.sql(SQL[name]).df()) is None
