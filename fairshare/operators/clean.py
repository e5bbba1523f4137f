"""Projection and row cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.functions.parse import typed

Spec = list[tuple[str, str, str]]


def prepare(df: DataFrame, spec: Spec, required: Iterable[str] = ()) -> DataFrame:
    """Project ``(source, kind, target)`` columns; drop rows with a null in a required one."""
    out = df.select(*[typed(df, source, kind).alias(target) for source, kind, target in spec])
    columns = list(required)
    return out.na.drop(subset=columns) if columns else out


def clamp_negatives(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns(
        {c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns}
    )


def unbacked_funding():
    """Funding without any requirement: a recording error."""
    return (F.col("total_requirements_usd") == 0) & (F.col("total_funding_usd") > 0)


def drop_unbacked(df: DataFrame) -> DataFrame:
    return df.where(~unbacked_funding())


def count_unbacked(df: DataFrame) -> DataFrame:
    """(rows_before, rows_after, dropped) of ``drop_unbacked``, in one pass."""
    rows, dropped = F.count(F.lit(1)), F.count_if(unbacked_funding())
    return df.agg(
        rows.alias("rows_before"), (rows - dropped).alias("rows_after"), dropped.alias("dropped")
    )
