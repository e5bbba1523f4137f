"""Registered queries over tables with nulls, repeats and nothing at all, against their SQL."""

import duckdb
import pytest

from checks.compare import differences
from fairshare.llm.oracle import SQL
from fairshare.llm.queries import QUERIES

LONG = "é<p>" * 50_000
PAGES = [
    (1, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, None, None), (4, "", ""), (5, "http://c", LONG),
    (6, "http://d", LONG), (7, "http://e", "one"), (8, "http://f", "\r\n\r\nWARC/1.1\r\n"), (10, "http://g", " "),
]


def written(spark, rows, folder):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{folder}/pages.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view pages as from read_parquet('{folder}/pages.parquet/*.parquet')")
    return connection


@pytest.mark.parametrize("rows", [PAGES, PAGES[:1], []], ids=["odd", "one", "none"])
def test_archives_of_odd_pages(spark, tmp_path, rows):
    connection = written(spark, rows, tmp_path)
    got = QUERIES["op3_warc"](spark, str(tmp_path)).toPandas()
    wanted = connection.sql(SQL["op3_warc"]).df()
    assert len(got) == len(rows) and set(got.columns) == set(wanted.columns)
    if rows:
        assert differences(got, wanted) is None
    links = {(a, int(b)) for a, b in zip(got["page_id"], got["refers_to"]) if b == b and b is not None}
    assert links == ({(1, 9), (2, 9), (3, 4), (5, 6)} if len(rows) > 1 else set())
