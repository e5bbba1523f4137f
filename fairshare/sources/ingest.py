"""Loading a set of files into raw tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fairshare.sources.coerce import safe_coerce
from fairshare.sources.csv import load_csv, load_hxl
from fairshare.sources.names import plain_name
from fairshare.sources.tables import ensure_database, write_table


@dataclass(frozen=True)
class Dataset:
    """A file, how to read it, and literal columns to add.

    ``multi_line`` states whether records span lines; ``None`` looks.
    """

    path: str
    hxl: bool = False
    clean: Callable[[str | None], str] = plain_name
    constants: dict[str, Any] = field(default_factory=dict)
    threshold: float = 0.8
    multi_line: bool | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        """The raw frame, text columns not yet coerced."""
        if self.hxl:
            df = load_hxl(spark, self.path, self.multi_line)
        else:
            df = load_csv(spark, self.path, self.clean, self.multi_line)
        return df.withColumns({k: F.lit(v) for k, v in self.constants.items()})


def ingest(
    spark: SparkSession,
    datasets: dict[str, Dataset],
    database: str,
    fmt: str = "parquet",
    prefix: str = "raw_",
    coerce: bool = True,
) -> DataFrame:
    """Write each dataset to ``database.<prefix><name>``.

    One that fails does not stop the others. Returns (dataset, rows, cols, error); rows are
    counted while the table is written.
    """
    ensure_database(spark, database)
    status = []
    for name, dataset in datasets.items():
        try:
            df = dataset.load(spark)
            if coerce:
                df = safe_coerce(df, dataset.threshold)
            seen = Observation()
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            write_table(counted, f"{database}.{prefix}{name}", fmt)
            status.append((name, seen.get["rows"], len(df.columns), None))
        except Exception as error:
            status.append((name, None, None, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(status, "dataset string, rows long, cols int, error string")


def summarize(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, cols, schema), one row per frame."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(len(df.columns)).alias("cols"),
            F.lit(df.schema.simpleString()).alias("schema"),
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
