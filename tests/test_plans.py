"""Plans hold what scale needs: no Python rows in relational work, no products, no lone task."""

import pytest
from pyspark.sql import functions as F

from checks import proxies, queries
from fairshare.operators import allocate, features, filters, peers, quality, scaling
from fairshare.plans import tables


def plan(df):
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


RELATIONAL = [
    "prep_requirements", "merged_requirements", "contributions_by_fund_year", "feature_table",
    "null_profile", "issues", "kpis", "gap_by_country", "metric_map", "project_points",
    "coverage_heatmap", "pledged_vs_paid", "allocate_impact", "flag_by_contamination",
    "filtered_features", "scaled_features",
]


@pytest.mark.parametrize("name", RELATIONAL)
def test_relational_work_stays_in_the_engine(spark, sf_dir, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text, bad


def test_feature_build_reads_each_source_once(spark, sf_dir):
    text = plan(tables.features_table(proxies.feature_sources(spark, sf_dir)))
    assert text.count("lineitem.parquet") == 1 and text.count("orders.parquet") == 1
    assert "l_quantity" not in text and "l_tax" not in text
    assert text.count("Window [") <= 1


def test_profile_is_one_scan(spark, sf_dir):
    rows = queries.feature_rows(spark, sf_dir)
    for check in (quality.null_profile, quality.range_check, quality.zero_check):
        assert plan(check(rows)).count("Location:") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    rows = queries.feature_rows(spark, sf_dir)
    picked = filters.Selection(countries=["NATION_1"], years=[1999], min_gap=10)
    text = plan(filters.apply_selection(rows, picked).select("funding_gap_pct"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    for part in ("country_code", "year", "GreaterThanOrEqual(funding_gap_pct"):
        assert part in pushed
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "total_inneed" not in schema


def test_context_joins_are_not_forced_to_broadcast(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = queries.feature_rows(spark, sf_dir).select(*features.KEY)
        dim = base.groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))
        assert "SortMergeJoin" in plan(features.join_context(base, dim))
        ready = scaling.ml_ready(queries.feature_rows(spark, sf_dir))
        against = peers.peer_benchmark(ready.withColumn("cluster_id", F.lit(1)))
        assert "Window" not in plan(against)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_allocation_sums_within_buckets(spark, sf_dir):
    text = plan(allocate.allocate(queries.feature_rows(spark, sf_dir), 1e6))
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert sum("sum(requirements" in line for line in windows) == 1
    assert "windowspecdefinition(_bucket" in next(x for x in windows if "sum(requirements" in x)
