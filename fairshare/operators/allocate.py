"""Spending a fixed budget for the greatest effect.

Maximise ``sum(value * x)`` subject to ``sum(requirements * x) <= budget`` and ``0 <= x <= 1``.
With one budget and a share per line the optimum is greedy: fund lines in the order of value per
dollar until the money ends. That needs a running total in that order and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairshare.functions.parse import epsilon_ratio
from fairshare.operators.prefix import running_total
from fairshare.operators.serving import total

LINE = ["country_code", "cluster_name"]
OBJECTIVES = ("impact", "beneficiaries")


def budget_lines(features: DataFrame) -> DataFrame:
    """One row per country and cluster with a requirement above zero."""
    by = features.na.drop(subset=LINE).groupBy(*LINE)
    lines = by.agg(
        total("total_requirements_usd").alias("requirements"),
        total("total_targeted").alias("targeted"),
    ).where("requirements > 0")
    return lines.withColumn(
        "impact_per_dollar", epsilon_ratio(F.col("targeted"), F.col("requirements"))
    )


def available_funding(features: DataFrame) -> DataFrame:
    """The default budget: all funding of the rows, one row."""
    return features.agg(total("total_funding_usd").alias("budget_usd"))


def share_of_requirements(features: DataFrame, share: float) -> DataFrame:
    """A budget that covers ``share`` of what the budget lines require, one row."""
    return budget_lines(features).agg((total("requirements") * share).alias("budget_usd"))


def allocate(
    features: DataFrame,
    budget: float | DataFrame | None = None,
    objective: str = "impact",
    buckets: int | None = None,
) -> DataFrame:
    """Budget lines with ``allocation`` (0..1), ``allocated_usd`` and ``expected_beneficiaries``.

    ``objective`` values a line by its beneficiaries per dollar (``impact``) or its beneficiaries.
    ``budget`` is a number or a one-row frame; by default all funding of the rows. Lines that reach
    nobody get nothing. Among lines of equal worth the first by key is funded first.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    value = F.col("impact_per_dollar" if objective == "impact" else "targeted")
    lines = budget_lines(features).withColumn("_worth", value / F.col("requirements"))
    order = [F.desc("_worth"), *[F.asc(c) for c in LINE]]
    spent = running_total(lines, order, "requirements", "_spent", buckets)
    if budget is None:
        budget = available_funding(features)
    available: Column = budget.scalar() if isinstance(budget, DataFrame) else F.lit(float(budget))
    left = (available - F.col("_spent")) / F.col("requirements")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))
    x = F.when(F.col("_worth") > 0, share).otherwise(F.lit(0.0))
    return (
        spent.withColumn("allocation", x)
        .withColumns(
            {
                "allocated_usd": F.col("allocation") * F.col("requirements"),
                "expected_beneficiaries": F.col("allocation") * F.col("targeted"),
            }
        )
        .drop("_worth", "_spent")
    )


def by_reach(alloc: DataFrame) -> DataFrame:
    return alloc.orderBy(F.desc("expected_beneficiaries"), *LINE)


def allocation_totals(alloc: DataFrame) -> DataFrame:
    """(total_beneficiaries, total_allocated, impact_per_dollar), one row."""
    people, spent = total("expected_beneficiaries"), total("allocated_usd")
    return alloc.agg(
        people.alias("total_beneficiaries"),
        spent.alias("total_allocated"),
        (people / F.greatest(spent, F.lit(1.0))).alias("impact_per_dollar"),
    )


def funded_lines(alloc: DataFrame) -> DataFrame:
    """The lines that get more than one percent of what they require."""
    return alloc.where("allocation > 0.01")


def top_allocations(alloc: DataFrame, n: int = 20) -> DataFrame:
    return by_reach(funded_lines(alloc)).limit(n)
