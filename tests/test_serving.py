import math

import pytest

from fairshare.operators import filters, serving
from fairshare.operators.filters import Selection

SCHEMA = "country_code string, cluster_name string, year int, total_requirements_usd double, \
total_funding_usd double, funding_gap_usd double, funding_gap_pct double, \
funding_coverage_rate double, total_inneed double"


@pytest.fixture
def table(rows):
    return rows(
        SCHEMA,
        ("A", "x", 2020, 100.0, 40.0, 60.0, 60.0, 0.4, 10.0),
        ("A", "y", 2021, 50.0, 50.0, 0.0, 0.0, 1.0, 5.0),
        ("B", "x", 2021, 10.0, 20.0, -10.0, -100.0, 2.0, None),
        ("B", None, 2021, 0.0, 0.0, None, None, None, 1.0),
        (None, "x", 2022, 5.0, 1.0, 4.0, 80.0, 0.2, 1.0),
    )


def test_empty_selection_keeps_everything_but_negative_gaps(table):
    assert filters.apply_selection(table, Selection()).count() == 4
    assert filters.apply_selection(table, Selection(min_gap=-1000)).count() == 5
    assert filters.apply_selection(table, Selection(min_gap=1)).count() == 2


def test_selection(table):
    picked = Selection(countries=["A"], years=[2020, 2021], min_gap=0)
    assert filters.apply_selection(table, picked).count() == 2
    assert filters.apply_selection(table, picked, {"countries": "absent"}).count() == 4


def test_default_selection(table):
    got = filters.default_selection(table, countries=1, clusters=5, years=2)
    assert got == Selection(countries=["A"], clusters=["x", "y"], years=[2022, 2021])


def test_filter_values(table):
    assert [r[0] for r in filters.filter_values(table, "cluster_name").collect()] == ["x", "y"]
    years = [r[0] for r in filters.filter_values(table, "year", descending=True).collect()]
    assert years == [2022, 2021, 2020]


def test_kpis(table, rows):
    flags = rows("is_anomaly int", (1,), (0,), (1,))
    got = serving.kpis(table, flags).first()
    assert got["total_requirements_usd"] == 165.0 and got["total_gap_usd"] == 54.0
    assert math.isclose(got["avg_coverage_pct"], 90.0) and got["anomalies_flagged"] == 2
    bare = serving.kpis(table.select("total_requirements_usd", "total_funding_usd")).first()
    assert bare["total_gap_usd"] == 54.0 and bare["avg_coverage_pct"] == 0.0
    assert bare["total_inneed"] == 0.0 and bare["anomalies_flagged"] == 0
    assert serving.kpis(table.limit(0)).first()["total_funding_usd"] == 0.0


def test_groups_leave_null_keys_out(table):
    gaps = serving.gap_by_country(table).collect()
    assert [r["country_code"] for r in gaps] == ["A", "B"]
    assert [r["cluster_name"] for r in serving.coverage_by_cluster(table).collect()] == ["x", "y"]
    assert [r["year"] for r in serving.yearly_trend(table).collect()] == [2020, 2021, 2022]
    assert serving.country_bubbles(table).count() == 2


def test_heatmap(table):
    got = serving.coverage_heatmap(table)
    assert got.columns == ["country_code", "x", "y", "row_mean"]
    assert [tuple(r) for r in got.collect()] == [("A", 0.4, 1.0, 0.7), ("B", 2.0, 0.0, 1.0)]
    assert serving.coverage_heatmap(table.limit(0)).count() == 0
    assert serving.coverage_heatmap(table, n=1).count() == 1


def test_contributions(rows):
    gifts = rows("country_name string, year int, total_pledged_usd double, total_paid_usd double",
                 ("A", 2020, 2e6, None), ("A", 2021, 1e6, 5e5), ("B", 2021, 1e6, 7e5))
    assert [tuple(r) for r in serving.top_funds(gifts).collect()] == [("B", 7e5), ("A", 5e5)]
    assert [tuple(r) for r in serving.top_funds(gifts, [2020]).collect()] == [("A", 0.0)]
    assert [tuple(r) for r in serving.pledged_vs_paid(gifts).collect()] == [
        (2020, 2.0, 0.0), (2021, 2.0, 1.2)]


def test_points(rows):
    df = rows("project_code string, latitude double, longitude double, cluster string, \
budget double, org_name string", ("b", 1.0, 2.0, "c", 3.0, "o"), ("a", None, 2.0, "c", 3.0, "o"))
    assert [r["project_code"] for r in serving.project_points(df).collect()] == ["b"]


ANOMALIES = "country_code string, cluster_name string, year int, funding_gap_pct double, \
funding_coverage_rate double, anomaly_score double, is_anomaly int"


def test_anomaly_reports(rows):
    df = rows(
        ANOMALIES,
        ("B", "x", 1, 8.0, 2.0, 0.5, 1),
        ("A", "x", 1, 9.0, 1.0, 0.5, 1),
        ("C", "y", 1, 1.0, 1.0, 0.9, 0),
    )
    top = serving.top_anomalies(df).collect()
    assert [r["country_code"] for r in top] == ["A", "B"]
    assert serving.worst_anomaly(df).first()["country_code"] == "A"
    assert tuple(serving.anomaly_summary(df).first()) == (2, 2 / 3)
    assert [tuple(r) for r in serving.anomalies_by_sector(df).collect()] == [("x", 2)]
    assert serving.score_vs_gap(df).count() == 3
    radar = {(r["profile"], r["feature"]): r["value"] for r in serving.radar(df).collect()}
    assert radar["Worst Anomaly", "funding_gap_pct"] == 1.0
    assert radar["Average", "funding_coverage_rate"] == 0.0
    one = serving.radar(df, ["funding_gap_pct"]).collect()
    assert [r["value"] for r in one] == [0.0, 0.0]
    assert serving.radar(df.where("is_anomaly = 0")).count() == 0


def test_map_of_several_metrics(table):
    got = serving.metric_map(table, ["funding_gap_pct", "total_inneed"]).collect()
    values = {(r["country_code"], r["metric"]): r["value"] for r in got}
    assert values["A", "funding_gap_pct"] == 30.0 and values["B", "total_inneed"] == 1.0
