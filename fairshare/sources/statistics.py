"""Counts and ranges of Parquet tables from their footers, without reading a row."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StructType,
    VariantType,
)

#: Types whose least and greatest value a footer holds exactly.
RANGED = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)
NESTED = (ArrayType, MapType, StructType, VariantType)

#: What makes Spark answer counts, minima and maxima from footers.
PUSHDOWN = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}

SCHEMA = "dataset string, `column` string, rows long, filled long, least double, most double"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that answers from footers; the settings of ``spark`` stay."""
    other = spark.newSession()
    for key, value in PUSHDOWN.items():
        other.conf.set(key, value)
    return other


def _columns(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema.fields if not isinstance(f.dataType, NESTED)}


def _measures(columns: dict[str, DataType], pushed: bool) -> list[Column]:
    """Row count, then filled values and both ends of each column."""
    out = [F.count(F.lit(1))]
    for name, kind in columns.items():
        x = F.col(f"`{name}`")
        # footers leave NaN out, or hold no range where there is one
        number = F.when(~F.isnan(x), x) if isinstance(kind, (FloatType, DoubleType)) and not pushed else x
        ends = [F.min(number), F.max(number)] if isinstance(kind, RANGED) else []
        out += [F.count(x), *ends]
    return out


def footer_totals(spark: SparkSession, path: str, columns: dict[str, DataType] | None = None) -> DataFrame:
    """One row: the rows of a Parquet table, then per column what ``file_statistics`` reports of it.

    The plan holds the pushed aggregate and scans no rows. It fails when it runs if a row group has no
    range of a column in its footer.
    """
    df = footer_session(spark).read.parquet(path)
    return df.agg(*_measures(_columns(df) if columns is None else columns, pushed=True))


def _table_statistics(spark: SparkSession, path: str) -> tuple[int, dict[str, tuple]]:
    """(rows, column: (filled, least, most)), from footers as far as they tell."""
    df = spark.read.parquet(path)
    columns = _columns(df)

    def read(totals: DataFrame, wanted: dict[str, DataType]) -> tuple[int, dict[str, tuple]]:
        cells = iter(totals.first())
        rows = next(cells) or 0  # counts of no files at all come back as null
        ends = {c: isinstance(kind, RANGED) for c, kind in wanted.items()}
        return rows, {c: (next(cells) or 0, *([next(cells), next(cells)] if e else [None, None])) for c, e in ends.items()}

    def from_footers(wanted: dict[str, DataType]) -> tuple[int, dict[str, tuple]] | None:
        try:
            return read(footer_totals(spark, path, wanted), wanted)
        except (PySparkException, Py4JJavaError) as error:
            if "No min/max found" not in str(error):
                raise
            return None

    whole = from_footers(columns)
    if whole:
        return whole
    plain = {c: kind for c, kind in columns.items() if not isinstance(kind, RANGED)}
    rows, found = from_footers(plain)
    untold = {}
    for column, kind in columns.items():
        if column not in plain:
            own = from_footers({column: kind})
            if own:
                found |= own[1]
            else:
                untold[column] = kind
    found |= read(df.agg(*_measures(untold, pushed=False)), untold)[1]
    return rows, {c: found[c] for c in columns}


def file_statistics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(dataset, column, rows, filled, least, most) of the Parquet tables at ``paths``.

    ``filled`` counts values that are not null. ``least`` and ``most`` are the range of a number column
    as doubles, NaN aside; null for other types and where there is no number. Nested columns have no row. Row
    groups answer from their footers, so cost grows with the number of files and not with their size.
    Only columns that some row group has no range of (all its values are null, or its writer left
    it out, as for NaN) are scanned, in one pass, with the same result. One row per table comes to the driver.
    """
    out = []
    for name, path in paths.items():
        rows, found = _table_statistics(spark, path)
        for column, (filled, *ends) in found.items():
            # a negative zero is a zero
            out.append((name, column, rows, filled, *[None if e is None else float(e) + 0.0 for e in ends]))
    return spark.createDataFrame(out, SCHEMA)
