"""Aggregates that bring each source to its join grain.

All are plain hash aggregates: rows are combined on the map side, so a key that holds a large
share of the rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.operators.clean import clamp_negatives, drop_unbacked

MONEY = ["total_requirements_usd", "total_funding_usd"]


def clean_requirements(prepped: DataFrame) -> DataFrame:
    """Missing money is zero; negative funding (a refund) is zero."""
    return clamp_negatives(prepped.na.fill(0.0, subset=MONEY), ["total_funding_usd"])


def merge_appeals(cleaned: DataFrame) -> DataFrame:
    """One row per country, cluster and year; a null cluster is a group of its own."""
    return cleaned.groupBy("country_code", "cluster_name", "year").agg(
        F.sum("total_requirements_usd").alias("total_requirements_usd"),
        F.sum("total_funding_usd").alias("total_funding_usd"),
        F.avg("funding_pct").alias("funding_pct"),
        F.count("appeal_id").alias("num_appeals"),
    )


def requirements_base(prepped: DataFrame) -> DataFrame:
    """Clean, merge, and drop funding without requirements."""
    return drop_unbacked(merge_appeals(clean_requirements(prepped)))


def needs_by(prepped: DataFrame, keys: Iterable[str] = ("country_code",)) -> DataFrame:
    return prepped.groupBy(*keys).agg(
        F.sum("inneed").alias("total_inneed"),
        F.sum("targeted").alias("total_targeted"),
        F.sum("population").alias("hno_population"),
    )


def population_by(
    prepped: DataFrame, keys: Iterable[str] = ("country_code",), latest_only: bool = False
) -> DataFrame:
    """Population per key, over all reference years or only the latest one of each key."""
    if not latest_only:
        return prepped.groupBy(*keys).agg(F.sum("population").alias("total_population"))
    yearly = prepped.groupBy(*keys, "ref_year").agg(F.sum("population").alias("p"))
    return yearly.groupBy(*keys).agg(F.max_by("p", "ref_year").alias("total_population"))


def contributions_by_fund_year(prepped: DataFrame, approximate: bool = False) -> DataFrame:
    """Pledges, payments and number of donors per fund and year."""
    donors = F.approx_count_distinct if approximate else F.count_distinct
    return prepped.groupBy("country_name", "year").agg(
        F.sum("pledge_usd").alias("total_pledged_usd"),
        F.sum("paid_usd").alias("total_paid_usd"),
        donors("donor_name").alias("num_donors"),
    )


#: Base-two logarithm of a donor sketch's slots: counts are off by 0.65 % (one deviation).
DONOR_SKETCH = 14


def donor_sketches(prepped: DataFrame, size: int = DONOR_SKETCH) -> DataFrame:
    """(country_name, year, donors): a distinct-count sketch per fund and year, to be stored.

    A null donor counts for nothing, as in the exact count; a group of null donors alone keeps an
    empty sketch. A sketch takes at most ``2 ** size`` bytes, however many donors there are.
    """
    sketch = F.hll_sketch_agg("donor_name", F.lit(size)).alias("donors")
    return prepped.groupBy("country_name", "year").agg(sketch)


def donors_by(sketches: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, num_donors): stored sketches merged up to coarser keys, or to one row, and counted.

    A donor of several funds or years counts once, which sums of exact counts can't give; no
    contribution is read again. ``num_donors`` is approximate (``donor_error``).
    """
    merged = F.hll_union_agg("donors").alias("donors")
    by = sketches.groupBy(*keys).agg(merged)
    count = F.coalesce(F.hll_sketch_estimate("donors"), F.lit(0).cast("long"))
    return by.withColumn("num_donors", count).drop("donors")


def donor_error(size: int = DONOR_SKETCH) -> float:
    """One relative standard deviation of a merged count."""
    return 0.8326 / 2 ** (size / 2)


def disasters_by_country(prepped: DataFrame, since_year: int = 2019) -> DataFrame:
    recent = prepped.where(F.col("year") >= since_year)
    return recent.groupBy("country_code").agg(
        F.count("disaster_type").alias("num_disasters_5yr"),
        F.sum("total_deaths").alias("total_disaster_deaths_5yr"),
        F.sum("total_affected_disaster").alias("total_disaster_affected_5yr"),
        F.sum("total_damage_000usd").alias("total_disaster_damage_000usd_5yr"),
    )
