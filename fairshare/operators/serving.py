"""The summaries an analyst reads: small results from one aggregate each.

Group keys that are null are left out and the sum of nothing is zero, as in the reports these
summaries feed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairshare.functions.parse import epsilon_ratio
from fairshare.operators.features import KEY
from fairshare.operators.filters import filter_values, flagged, where_in

# The columns of the map, the radar and the top table.
MAP_METRICS = [
    "funding_gap_pct", "funding_coverage_rate", "total_funding_usd",
    "total_requirements_usd", "disaster_severity_score", "total_inneed",
]
RADAR_FEATURES = [
    "funding_coverage_rate", "funding_gap_pct", "beneficiary_to_funding_ratio",
    "need_to_requirements_ratio", "targeting_coverage_rate", "disaster_severity_score",
]
TOP_COLUMNS = [
    "country_code", "cluster_name", "year", "total_requirements_usd", "total_funding_usd",
    "funding_gap_pct", "anomaly_score", "cluster_id",
]


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0))


def _money_by(df: DataFrame, *keys: str) -> DataFrame:
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(
            total("total_requirements_usd").alias("requirements"),
            total("total_funding_usd").alias("funding"),
        )
    )


def kpis(features: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """One row of headline figures; a column the input lacks falls back as documented."""
    has = features.columns
    req, fund = total("total_requirements_usd"), total("total_funding_usd")
    zero = F.lit(0.0)
    row = features.agg(
        req.alias("total_requirements_usd"),
        fund.alias("total_funding_usd"),
        (total("funding_gap_usd") if "funding_gap_usd" in has else req - fund).alias(
            "total_gap_usd"
        ),
        (F.avg("funding_coverage_rate") * 100 if "funding_coverage_rate" in has else zero).alias(
            "avg_coverage_pct"
        ),
        (total("total_inneed") if "total_inneed" in has else zero).alias("total_inneed"),
    )
    flags = F.lit(0).cast("long")
    if anomalies is not None and "is_anomaly" in anomalies.columns:
        found = anomalies.agg(F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long"))
        flags = found.scalar()
    return row.withColumn("anomalies_flagged", flags)


def kpi_units(row: DataFrame) -> DataFrame:
    """The headline figures in display units: billions, millions, percent."""
    return row.select(
        (F.col("total_requirements_usd") / 1e9).alias("requirements_bn"),
        (F.col("total_funding_usd") / 1e9).alias("funded_bn"),
        (F.col("total_gap_usd") / 1e9).alias("gap_bn"),
        "avg_coverage_pct",
        (F.col("total_inneed") / 1e6).alias("inneed_mn"),
        "anomalies_flagged",
    )


def gap_by_country(features: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` countries with the widest funding gap."""
    req, fund = F.col("requirements"), F.col("funding")
    by = _money_by(features, "country_code")
    gaps = by.withColumn("gap_pct", epsilon_ratio(req - fund, req) * 100)
    return gaps.orderBy(F.desc("gap_pct"), "country_code").limit(n)


def coverage_by_cluster(features: DataFrame) -> DataFrame:
    by = _money_by(features, "cluster_name")
    covered = epsilon_ratio(F.col("funding"), F.col("requirements")) * 100
    return by.withColumn("coverage", covered).orderBy("coverage", "cluster_name")


def yearly_trend(features: DataFrame) -> DataFrame:
    """Requirements and funding per year, also in billions."""
    return (
        _money_by(features, "year")
        .withColumns(
            {
                "requirements_bn": F.col("requirements") / 1e9,
                "funding_bn": F.col("funding") / 1e9,
            }
        )
        .orderBy("year")
    )


def metric_map(features: DataFrame, metrics: Iterable[str] = MAP_METRICS[:1]) -> DataFrame:
    """(country_code, metric, value): the mean per country of each metric, from one grouping."""
    names = list(metrics)
    by = features.na.drop(subset=["country_code"]).groupBy("country_code")
    means = by.agg(*[F.avg(m).alias(m) for m in names])
    return means.unpivot(["country_code"], names, "metric", "value")


def project_points(projects: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` located projects by code."""
    wanted = ["project_code", "latitude", "longitude", "cluster", "budget", "org_name"]
    located = projects.na.drop(subset=["latitude", "longitude"])
    columns = [c for c in wanted if c in projects.columns]
    return located.select(*columns).orderBy(*columns).limit(n)


def country_bubbles(features: DataFrame) -> DataFrame:
    return (
        features.na.drop(subset=["country_code"])
        .groupBy("country_code")
        .agg(
            total("total_requirements_usd").alias("requirements"),
            total("total_funding_usd").alias("funding"),
            total("total_inneed").alias("inneed"),
        )
    )


def bubble_diagonal(bubbles: DataFrame) -> DataFrame:
    """The end of the fully-funded line: the largest of either axis."""
    top = F.greatest(F.max("requirements"), F.max("funding"))
    return bubbles.agg(top.alias("max_val"))


def coverage_heatmap(features: DataFrame, n: int = 20) -> DataFrame:
    """Mean coverage per country and cluster, one column per cluster, a missing pair being 0.

    Keeps the ``n`` countries with the lowest row mean. Spark's own limit on pivot values bounds
    the number of columns.
    """
    limit = int(features.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    values = filter_values(features, "cluster_name").limit(limit + 1).collect()
    clusters = [r["cluster_name"] for r in values]
    if len(clusters) > limit:
        raise ValueError(f"more than {limit} clusters: too many for columns")
    grid = (
        features.na.drop(subset=["country_code", "cluster_name"])
        .groupBy("country_code")
        .pivot("cluster_name", clusters)
        .agg(F.avg("funding_coverage_rate"))
        .na.fill(0.0)
    )
    if not clusters:
        return grid.withColumn("row_mean", F.lit(0.0)).limit(0)
    summed = sum((F.col(f"`{c}`") for c in clusters[1:]), F.col(f"`{clusters[0]}`"))
    return (
        grid.withColumn("row_mean", summed / len(clusters))
        .orderBy("row_mean", "country_code")
        .limit(n)
    )


def top_funds(contributions: DataFrame, years: Iterable[int] = (), n: int = 15) -> DataFrame:
    """The ``n`` funds that were paid most in the chosen years."""
    picked = where_in(contributions, "year", years).na.drop(subset=["country_name"])
    paid = picked.groupBy("country_name").agg(total("total_paid_usd").alias("total_paid_usd"))
    return paid.orderBy(F.desc("total_paid_usd"), "country_name").limit(n)


def pledged_vs_paid(contributions: DataFrame, years: Iterable[int] = ()) -> DataFrame:
    """Pledged and paid per year in millions."""
    picked = where_in(contributions, "year", years).na.drop(subset=["year"])
    return (
        picked.groupBy("year")
        .agg(
            (total("total_pledged_usd") / 1e6).alias("pledged_mn"),
            (total("total_paid_usd") / 1e6).alias("paid_mn"),
        )
        .orderBy("year")
    )


def score_vs_gap(anomalies: DataFrame) -> DataFrame:
    points = anomalies.na.drop(subset=["anomaly_score", "funding_gap_pct"])
    return points.select(*KEY, "funding_gap_pct", "anomaly_score", "is_anomaly")


def anomalies_by_sector(anomalies: DataFrame) -> DataFrame:
    by = "cluster_name" if "cluster_name" in anomalies.columns else "cluster_id"
    return flagged(anomalies).groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def _by_score() -> list[Column]:
    return [F.desc("anomaly_score"), *[F.asc(c) for c in KEY]]


def top_anomalies(anomalies: DataFrame, n: int = 20, extra: Iterable[str] = ()) -> DataFrame:
    """The ``n`` flagged rows with the highest score."""
    columns = [c for c in [*TOP_COLUMNS, *extra] if c in anomalies.columns]
    return flagged(anomalies).orderBy(*_by_score()).limit(n).select(*columns)


def worst_anomaly(anomalies: DataFrame) -> DataFrame:
    return flagged(anomalies).orderBy(*_by_score()).limit(1)


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("anomaly_count"),
        F.avg("is_anomaly").alias("anomaly_rate"),
    )


def radar(anomalies: DataFrame, features: Iterable[str] = RADAR_FEATURES) -> DataFrame:
    """(profile, feature, value): the worst anomaly and the mean of all rows.

    Each profile is scaled to 0..1 across its own features; with no spread all are 0. Both come
    from one aggregate, so no row but the worst leaves the scan.
    """
    names = [f for f in features if f in anomalies.columns]
    own = F.struct(*[F.col(f).cast("double").alias(f) for f in names])
    rank = F.struct((-F.col("anomaly_score")).alias("s"), *KEY)
    is_flagged = F.col("is_anomaly") == 1
    both = anomalies.agg(
        F.min_by(own, F.when(is_flagged, rank)).alias("worst"),
        F.struct(*[F.avg(f).alias(f) for f in names]).alias("average"),
    ).where("worst is not null")
    rows = []
    for profile, source in (("Worst Anomaly", "worst"), ("Average", "average")):
        values = [F.col(f"{source}.{f}") for f in names]
        low, high = (F.least(*values), F.greatest(*values)) if len(names) > 1 else values * 2
        for name, value in zip(names, values):
            scaled = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
            rows.append(
                F.struct(
                    F.lit(profile).alias("profile"),
                    F.lit(name).alias("feature"),
                    scaled.alias("value"),
                )
            )
    return both.select(F.inline(F.array(*rows)))
