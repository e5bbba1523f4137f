"""Rows fit for modelling, and standard scaling."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.operators.features import KEY

# The nine features both models use.
ML_FEATURES = [
    "funding_coverage_rate",
    "funding_gap_pct",
    "beneficiary_to_funding_ratio",
    "need_to_requirements_ratio",
    "targeting_coverage_rate",
    "cost_per_beneficiary",
    "disaster_severity_score",
    "sector_funding_efficiency_pct",
    "project_vs_sector_avg",
]
# Fixed value: the spacing of doubles at one.
EPSILON = 2.220446049250313e-16
ML_COLUMNS = [*KEY, "total_requirements_usd", "total_funding_usd"]


def ml_ready(features: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Key and model columns of the rows that have every feature."""
    return features.select(*ML_COLUMNS, *extra, *ML_FEATURES).na.drop(subset=ML_FEATURES)


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column; no spread scales by one."""

    columns: list[str]
    rows: int
    means: list[float]
    deviations: list[float]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scaled columns, in place or under a prefix."""
        return df.withColumns(
            {
                f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s or 1.0)
                for c, m, s in zip(self.columns, self.means, self.deviations)
            }
        )


def moments(df: DataFrame, columns: Iterable[str] = ML_FEATURES) -> DataFrame:
    """(column, mean, deviation) from one aggregate."""
    names = list(columns)
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m_{c}").alias("mean"),
            F.col(f"s_{c}").alias("deviation"),
        )
        for c in names
    ]
    return row.select(F.inline(F.array(*rows)))


def fit_scaler(df: DataFrame, columns: Iterable[str] = ML_FEATURES) -> Scaler:
    """Fit in one job; only the moments reach the driver."""
    names = list(columns)
    found = df.agg(
        F.count(F.lit(1)),
        *[F.avg(c) for c in names],
        *[F.stddev_pop(c) for c in names],
    ).first()
    rows, means, deviations = found[0], found[1 : 1 + len(names)], found[1 + len(names) :]
    if rows == 0:
        raise ValueError("no rows to scale")
    spread = [0.0 if _is_noise(s, m, rows) else s for m, s in zip(means, deviations)]
    return Scaler(names, rows, list(means), spread)


def _is_noise(deviation: float, mean: float, rows: int) -> bool:
    """Whether a spread is no more than rounding leaves behind on equal values."""
    variance = deviation**2
    return variance <= rows * EPSILON * variance + (rows * mean * EPSILON) ** 2
