"""Filter values, the default selection, and the filter bundle of the serving queries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = {"countries": "country_code", "clusters": "cluster_name", "years": "year"}
GAP = "funding_gap_pct"


@dataclass(frozen=True)
class Selection:
    """What the analyst picked; an empty list selects everything."""

    countries: list[str] = field(default_factory=list)
    clusters: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    min_gap: float = 0
    anomalies_only: bool = False


def filter_values(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The distinct values of a column in order, nulls left out."""
    order = F.desc(column) if descending else F.asc(column)
    return df.select(column).na.drop().distinct().orderBy(order)


def default_selection(
    df: DataFrame, countries: int = 8, clusters: int = 5, years: int = 2
) -> Selection:
    """The first countries and clusters and the latest years, read in one job."""
    wanted = {"countries": countries, "clusters": clusters, "years": years}
    tops = [
        filter_values(df, COLUMNS[part], descending=part == "years")
        .limit(n)
        .select(F.lit(part).alias("part"), F.col(COLUMNS[part]).cast("string").alias("value"))
        for part, n in wanted.items()
    ]
    rows = reduce(DataFrame.unionByName, tops).collect()
    found = {part: sorted(r["value"] for r in rows if r["part"] == part) for part in wanted}
    found["years"] = sorted(map(int, found["years"]), reverse=True)
    return Selection(**found)


def where_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Keep rows whose column is one of ``values``; no values or no such column keeps all."""
    picked = list(values)
    return df.where(F.col(column).isin(picked)) if picked and column in df.columns else df


def where_gap(df: DataFrame, least: float) -> DataFrame:
    """Keep rows whose gap is at least ``least``, a missing gap counting as zero.

    Written without ``coalesce`` so that the scan can use it.
    """
    if GAP not in df.columns:
        return df
    wide_enough = F.col(GAP) >= F.lit(float(least))
    return df.where(wide_enough | F.col(GAP).isNull() if least <= 0 else wide_enough)


def apply_selection(
    df: DataFrame, pick: Selection, columns: dict[str, str] = COLUMNS
) -> DataFrame:
    """The filter bundle. ``columns`` names the column each list applies to; one that ``df`` does
    not have is not applied."""
    for part, column in columns.items():
        df = where_in(df, column, getattr(pick, part))
    df = where_gap(df, pick.min_gap)
    if pick.anomalies_only and "is_anomaly" in df.columns:
        df = flagged(df)
    return df


def flagged(anomalies: DataFrame) -> DataFrame:
    return anomalies.where("is_anomaly = 1")
