"""Formatting of report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dollars(c: Column) -> Column:
    """``1234.5`` to ``$1,234`` style text with no decimals."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def decimals(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def percent(c: Column, digits: int = 1, scale: float = 1.0) -> Column:
    """Percent text; pass ``scale=100`` for a fraction."""
    return F.concat(decimals(c * F.lit(scale), digits), F.lit("%"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def prettify(c: Column) -> Column:
    """``funding_gap_pct`` to ``Funding Gap Pct``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def anomaly_report(top: DataFrame) -> DataFrame:
    """The flagged-allocations table as text with report headers."""
    return top.select(
        F.col("country_code").alias("Country"),
        F.col("cluster_name").alias("Cluster"),
        F.col("year").alias("Year"),
        dollars(F.col("total_requirements_usd")).alias("Requirements"),
        dollars(F.col("total_funding_usd")).alias("Funded"),
        percent(F.col("funding_gap_pct")).alias("Gap %"),
        decimals(F.col("anomaly_score"), 3).alias("Score"),
    )


def allocation_report(alloc: DataFrame) -> DataFrame:
    """The allocation table as text with report headers."""
    return alloc.select(
        F.col("country_code").alias("Country"),
        F.col("cluster_name").alias("Cluster"),
        dollars(F.col("requirements")).alias("Requirements"),
        dollars(F.col("allocated_usd")).alias("Allocated"),
        percent(F.col("allocation"), 1, 100).alias("Allocation %"),
        thousands(F.col("expected_beneficiaries")).alias("Exp. Beneficiaries"),
        decimals(F.col("impact_per_dollar"), 4).alias("Impact/Dollar"),
    )
