from pyspark.sql import functions as F

from fairshare.operators import aggregates, clean, features, quality

REQ = "country_code string, cluster_name string, year int, appeal_id string, \
total_requirements_usd double, total_funding_usd double, funding_pct double"


def test_base(rows):
    prepped = rows(
        REQ,
        ("A", "x", 2020, "1", 100.0, 40.0, 40.0),
        ("A", "x", 2020, None, None, -9.0, None),
        ("A", None, 2020, "3", 10.0, None, 5.0),
        ("B", "x", 2020, "4", 0.0, 7.0, None),
        ("B", "x", 2021, "5", 0.0, 0.0, None),
    )
    base = aggregates.requirements_base(prepped).orderBy("country_code", "cluster_name", "year")
    assert [tuple(r) for r in base.collect()] == [
        ("A", None, 2020, 10.0, 0.0, 5.0, 1),
        ("A", "x", 2020, 100.0, 40.0, 40.0, 1),
        ("B", "x", 2021, 0.0, 0.0, None, 1),
    ]
    merged = aggregates.merge_appeals(aggregates.clean_requirements(prepped))
    assert tuple(clean.count_unbacked(merged).first()) == (4, 3, 1)


def test_join_keeps_the_base_and_fills(rows):
    base = rows("country_code string, total_funding_usd double", ("A", 1.0), ("B", 2.0))
    dim = rows("country_code string, total_inneed double, hno_population double", ("A", 5.0, 6.0))
    got = features.join_context(base, dim).orderBy("country_code").collect()
    assert [tuple(r) for r in got] == [("A", 1.0, 5.0, 6.0), ("B", 2.0, 0.0, None)]


def test_ratios_of_a_zero_requirement_are_null(rows):
    schema = "country_code string, cluster_name string, year int, total_requirements_usd double, \
total_funding_usd double"
    base = rows(schema, ("A", "x", 2020, 0.0, 0.0), ("A", "x", 2021, 10.0, 5.0))
    needs = rows("country_code string, total_inneed double, total_targeted double", ("A", 4.0, 2.0))
    people = rows("country_code string, total_population double", ("A", 0.0))
    storms = rows(
        "country_code string, num_disasters_5yr long, total_disaster_deaths_5yr double, "
        "total_disaster_affected_5yr double"
    )
    built = features.build_features(base, needs, people, storms).orderBy("year").collect()
    zero, full = built
    empty = {c for c in features.RATIOS if zero[c] is None}
    assert empty == set(features.RATIOS) - {
        "targeting_coverage_rate", "cost_per_beneficiary", "disaster_severity_score",
        "sector_funding_efficiency_pct",
    }
    assert zero["sector_funding_efficiency_pct"] == 50.0
    assert full["project_vs_sector_avg"] == 0.0 and full["funding_gap_pct"] == 50.0
    assert full["requirement_per_capita"] is None and full["disaster_severity_score"] == 0.0


def test_latest_population(rows):
    df = rows("country_code string, population double, ref_year int",
              ("A", 1.0, 2020), ("A", 2.0, 2021), ("A", 3.0, 2021))
    assert aggregates.population_by(df, latest_only=True).first()[1] == 5.0
    assert aggregates.population_by(df).first()[1] == 6.0


def test_approximate_donors(rows):
    df = rows("country_name string, year int, donor_name string, pledge_usd double, \
paid_usd double", ("A", 1, "n", 1.0, None), ("A", 1, "m", 1.0, None))
    assert tuple(aggregates.contributions_by_fund_year(df, True).first())[2:] == (2.0, None, 2)


SCHEMA = "country_code string, cluster_name string, year int, total_requirements_usd double, \
total_inneed double, disaster_severity_score double, funding_gap_pct double"


def test_quality(rows):
    df = rows(
        SCHEMA,
        ("A", "x", 2020, -1.0, 0.0, None, None),
        ("A", "x", 2020, 5.0, None, None, None),
        ("A", None, 2021, 0.0, 3.0, 1.0, 150.0),
        ("B", None, 2021, 4.0, 0.0, None, None),
    )
    nulls = {r["column"]: (r["nulls"], r["status"]) for r in quality.null_profile(df).collect()}
    assert nulls["cluster_name"] == (2, "warn") and nulls["funding_gap_pct"] == (3, "fail")
    assert nulls["country_code"] == (0, "ok") and len(nulls) == 7
    ranges = {r["column"]: r["status"] for r in quality.range_check(df).collect()}
    assert ranges["total_requirements_usd"] == "fail" and ranges["funding_gap_pct"] == "fail"
    assert ranges["total_inneed"] == "ok"
    zeros = {r["column"]: (r["zeros"], r["status"]) for r in quality.zero_check(df).collect()}
    assert zeros == {"total_requirements_usd": (1, "ok"), "total_inneed": (3, "fail")}
    joins = {r["column"]: (r["matched"], r["status"]) for r in quality.join_coverage(df).collect()}
    assert joins == {"total_inneed": (1, "warn"), "disaster_severity_score": (1, "warn")}
    assert tuple(quality.duplicate_keys(df).first()) == (4, 3, 1, "warn")
    assert [tuple(r) for r in quality.duplicate_groups(df).collect()] == [("A", "x", 2020, 2)]
    found = {(r["check"], r["column"]): r["value"] for r in quality.issues(df).collect()}
    assert found == {
        ("high null rate", "funding_gap_pct"): 75.0,
        ("high null rate", "disaster_severity_score"): 75.0,
        ("out of range", "total_requirements_usd"): -1.0,
        ("out of range", "funding_gap_pct"): 150.0,
        ("duplicate keys", "country_code, cluster_name, year"): 1.0,
    }


def test_quality_of_no_rows(rows):
    empty = rows(SCHEMA)
    assert quality.null_profile(empty).where("status <> 'ok'").count() == 0
    assert tuple(quality.duplicate_keys(empty).first()) == (0, 0, 0, "ok")
    checks = {r["check"] for r in quality.issues(empty).collect()}
    assert checks == {"low join coverage"}


def test_donor_sketches_merge_up(spark, rows):
    gifts = spark.range(60_000).selectExpr(
        "concat('fund ', id % 6) country_name", "cast(2015 + id % 5 as int) year",
        "if(id % 4 = 0, null, concat('donor ', hash(id) % 9000)) donor_name",
    )
    sketches = aggregates.donor_sketches(gifts)
    assert sketches.count() == 30
    for keys in (["country_name"], ["year"], ["country_name", "year"], []):
        exact = {tuple(r)[:-1]: r["n"] for r in gifts.groupBy(*keys).agg(F.count_distinct("donor_name").alias("n")).collect()}
        about = {tuple(r)[:-1]: r["num_donors"] for r in aggregates.donors_by(sketches, keys).collect()}
        assert exact.keys() == about.keys()
        assert all(abs(about[k] - exact[k]) <= 4 * aggregates.donor_error() * exact[k] + 1 for k in exact)
    few = rows("country_name string, year int, donor_name string", ("a", 1, None), (None, 1, "d"), (None, 2, "d"))
    found = aggregates.donors_by(aggregates.donor_sketches(few), ["country_name"]).collect()
    assert sorted((r["country_name"] or "", r["num_donors"]) for r in found) == [("", 1), ("a", 0)]
    none = aggregates.donor_sketches(few.limit(0))
    assert none.count() == 0 and aggregates.donors_by(none).first()["num_donors"] == 0
