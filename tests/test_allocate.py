import random

import pytest

from fairshare.operators import allocate
from fairshare.operators.prefix import running_total

SCHEMA = "country_code string, cluster_name string, total_requirements_usd double, \
total_targeted double, total_funding_usd double"


def lines(n, seed=1, tied=False):
    rng = random.Random(seed)
    return [
        (
            f"c{i % 7}",
            f"s{i:04d}",
            100.0 if tied else rng.randint(1, 1000) * 1.0,
            50.0 if tied else rng.choice([0.0, rng.randint(1, 500) * 1.0]),
            10.0,
        )
        for i in range(n)
    ]


def greedy(data, budget, impact):
    def worth(r):
        value = r[3] / (r[2] + 1e-9) if impact else r[3]
        return value / r[2]

    out, left = {}, budget
    for row in sorted(data, key=lambda r: (-worth(r), r[0], r[1])):
        share = max(0.0, min(1.0, left / row[2])) if worth(row) > 0 else 0.0
        out[row[0], row[1]] = share
        left -= row[2]
    return out


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("objective", allocate.OBJECTIVES)
def test_matches_one_by_one_spending(rows, objective, tied):
    data = lines(300, tied=tied)
    budget = 0.4 * sum(r[2] for r in data)
    got = allocate.allocate(rows(SCHEMA, *data), budget, objective, buckets=16).collect()
    wanted = greedy(data, budget, objective == "impact")
    assert len(got) == len(wanted)
    for row in got:
        assert abs(row["allocation"] - wanted[row["country_code"], row["cluster_name"]]) < 1e-9
    assert sum(r["allocated_usd"] for r in got) <= budget + 1e-6
    assert sum(0 < r["allocation"] < 1 for r in got) <= 1


def test_no_other_plan_reaches_more(rows):
    data = lines(60, seed=4)
    budget = 0.3 * sum(r[2] for r in data)
    got = allocate.allocate(rows(SCHEMA, *data), budget, "beneficiaries").collect()
    best = sum(r["expected_beneficiaries"] for r in got)
    rng = random.Random(9)
    for _ in range(200):
        left, reach = budget, 0.0
        for row in rng.sample(data, len(data)):
            share = min(1.0, left / row[2]) * rng.choice([1.0, rng.random()])
            left, reach = left - share * row[2], reach + share * row[3]
        assert reach <= best + 1e-6


def test_lines_and_budget(rows):
    df = rows(
        SCHEMA,
        ("A", "x", 10.0, 5.0, 4.0),
        ("A", "x", 10.0, None, 2.0),
        ("B", "x", 0.0, 5.0, 1.0),
        (None, "x", 9.0, 5.0, 3.0),
        ("C", "y", 10.0, 0.0, 0.0),
    )
    assert allocate.budget_lines(df).count() == 2
    got = {r["country_code"]: r for r in allocate.allocate(df).collect()}
    assert got["A"]["allocation"] == 0.5 and got["C"]["allocation"] == 0.0
    totals = allocate.allocation_totals(allocate.allocate(df)).first()
    assert tuple(totals) == (2.5, 10.0, 0.25)
    assert [r["country_code"] for r in allocate.top_allocations(allocate.allocate(df)).collect()] \
        == ["A"]
    with pytest.raises(ValueError):
        allocate.allocate(df, 1.0, "other")


def test_running_total_splits_a_value_that_fills_the_frame(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).selectExpr("id", "1.0D w", "id % 1 same")
    got = running_total(df, [F.asc("same"), F.asc("id")], "w", "before", buckets=8)
    assert got.where("before <> id").count() == 0 and got.count() == 2000
