"""The feature table: base rows, country context, ratios and sector totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.functions.parse import guarded_ratio

KEY = ["country_code", "cluster_name", "year"]

# Columns and what fills their gaps.
FILLS = {
    "total_funding_usd": 0.0,
    "total_requirements_usd": 0.0,
    "total_inneed": 0.0,
    "total_targeted": 0.0,
    "total_population": 0.0,
    "num_disasters_5yr": 0,
    "total_disaster_deaths_5yr": 0.0,
    "total_disaster_affected_5yr": 0.0,
}

# Names of the ratio columns, in their order.
RATIOS = [
    "funding_gap_usd", "funding_gap_pct", "funding_coverage_rate",
    "beneficiary_to_funding_ratio", "need_to_requirements_ratio", "targeting_coverage_rate",
    "cost_per_beneficiary", "funding_per_capita", "requirement_per_capita",
    "disaster_severity_score", "sector_funding_efficiency_pct", "project_vs_sector_avg",
]


def join_context(
    base: DataFrame, *dims: DataFrame, on: str = "country_code", fills: dict | None = None
) -> DataFrame:
    """Left-join one-row-per-country frames to the base and fill what they do not cover.

    No broadcast hint: how many countries there are is the data's business, so the adaptive plan
    broadcasts a side it has measured to be small and splits skewed partitions otherwise.
    """
    for dim in dims:
        base = base.join(dim, on=on, how="left")
    present = {c: v for c, v in (FILLS if fills is None else fills).items() if c in base.columns}
    return base.na.fill(present)


def with_sector_totals(df: DataFrame) -> DataFrame:
    """Add the funding and requirements of each row's country and cluster over all years.

    The input has one row per country, cluster and four-digit year, so a window partition holds
    at most a row per year. Both sums share one exchange and one sort.
    """
    sector = Window.partitionBy("country_code", "cluster_name")
    return df.withColumns(
        {
            "sector_total_funding_usd": F.sum("total_funding_usd").over(sector),
            "sector_total_requirements_usd": F.sum("total_requirements_usd").over(sector),
        }
    )


def severity() -> Column:
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return (
        zero("num_disasters_5yr") * F.lit(0.4)
        + zero("total_disaster_deaths_5yr") / F.lit(10_000) * F.lit(0.3)
        + zero("total_disaster_affected_5yr") / F.lit(1_000_000) * F.lit(0.3)
    )


def ratio_columns() -> dict[str, Column]:
    """Every derived column, each a guarded expression of the joined row and sector totals."""
    req, fund = F.col("total_requirements_usd"), F.col("total_funding_usd")
    inneed, targeted = F.col("total_inneed"), F.col("total_targeted")
    people = F.col("total_population")
    sector_fund = F.col("sector_total_funding_usd")
    sector_req = F.col("sector_total_requirements_usd")
    coverage = guarded_ratio(fund, req)
    sector_coverage = guarded_ratio(sector_fund, sector_req)
    return {
        "funding_gap_usd": F.when(req > 0, req - fund),
        "funding_gap_pct": guarded_ratio(req - fund, req) * 100,
        "funding_coverage_rate": coverage,
        "beneficiary_to_funding_ratio": guarded_ratio(targeted, fund),
        "need_to_requirements_ratio": guarded_ratio(inneed, req),
        "targeting_coverage_rate": guarded_ratio(targeted, inneed),
        "cost_per_beneficiary": guarded_ratio(fund, targeted),
        "funding_per_capita": guarded_ratio(fund, people),
        # guarded by the requirement, so a population of zero gives null
        "requirement_per_capita": guarded_ratio(req, people, guard=req),
        "disaster_severity_score": severity(),
        "sector_funding_efficiency_pct": sector_coverage * 100,
        "project_vs_sector_avg": coverage - sector_coverage,
    }


def with_ratios(df: DataFrame) -> DataFrame:
    ratios = ratio_columns()
    return df.select("*", *[ratios[name].alias(name) for name in RATIOS])


def build_features(base: DataFrame, *dims: DataFrame) -> DataFrame:
    """Base rows joined with their country context, plus sector totals and all ratios."""
    return with_ratios(with_sector_totals(join_context(base, *dims)))
