"""Every registered query against the SQL of its definition."""

import pytest

from checks.compare import differences, tables
from checks.oracle import SQL
from checks.queries import QUERIES

NO_SQL = {
    "isolation_forest", "anomalies", "top_anomalies", "top_anomalies_report", "worst_anomaly",
    "anomaly_summary", "anomalies_by_sector", "score_vs_gap", "radar",
    "peer_sweep", "peer_groups", "peer_group_sizes",
    "grouped_anomalies", "top_grouped_anomalies", "anomalies_by_group",
}


@pytest.fixture(scope="module")
def connection():
    return tables("/root/testdata/sf0.001")


def test_only_model_fits_have_no_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, connection, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert differences(ours, connection.sql(SQL[name]).df()) is None
    else:
        assert len(ours)


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
