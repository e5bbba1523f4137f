"""Tables: sink, source, and intermediate results that later steps read back."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that replace a table in one step.
ATOMIC = ("delta", "iceberg")

_local_dirs: dict[str, str] = {}


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


#: Property of a table's view that names the version it shows.
VERSION = "fairshare.version"


def write_table(
    df: DataFrame, table: str, fmt: str = "parquet", partition_by: Iterable[str] = ()
) -> None:
    """Replace ``table`` with ``df``, schema included.

    Rows are gathered by the partition columns first, and large values split again, so no
    value makes one huge file and no task opens a file per value. Formats without atomic replacement
    are written as versions, tables in a database of their own (``<database>__versions``), and
    ``table`` is a view of the present one. A write makes a new version beside the old one, then
    replaces the view, which is one change of the catalog, then drops the version that the view showed
    before. A crash between any two steps leaves the old table or the new one under the name; a version
    left over goes with ``drop_old_versions``.

    A plain table of that name that no view stands for yet is dropped right before the view is made; only that
    first replacement leaves a moment without the name.
    """
    columns = list(partition_by)
    if columns:
        df = df.hint("rebalance", *[F.col(c) for c in columns])
    writer = df.write.format(fmt)
    if columns:
        writer = writer.partitionBy(*columns)
    if fmt.lower() in ATOMIC:
        writer.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
        return
    spark = df.sparkSession
    versions, name = versions_of(spark, table)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {versions}")
    fresh = f"{versions}.{name}__{uuid4().hex[:12]}"
    try:
        writer.saveAsTable(fresh)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    before = shown_version(spark, table)
    if before is None and spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE {table}")
    spark.sql(
        f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{VERSION}' = '{fresh}') AS SELECT * FROM {fresh}"
    )
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {before}")


def versions_of(spark: SparkSession, table: str) -> tuple[str, str]:
    """The database that holds the versions of ``table``, and the table's bare name."""
    database, _, name = table.rpartition(".")
    database = database or spark.catalog.currentDatabase()
    quote = "`" if database.endswith("`") else ""
    return f"{database.removesuffix('`')}__versions{quote}", name.strip("`")


def shown_version(spark: SparkSession, table: str) -> str | None:
    """The version that ``table`` shows; None if there is no such table or it has no versions."""
    if not spark.catalog.tableExists(table):
        return None
    properties = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == VERSION).first()
    return properties["value"] if properties else None


def drop_old_versions(spark: SparkSession, table: str) -> list[str]:
    """Drop the versions of ``table`` that it does not show and return their names.

    Crashed writes leave them. No other write to the table may be under way. A plain table, or none,
    has versions only if a first write crashed, and these go too.
    """
    versions, name = versions_of(spark, table)
    if not spark.catalog.databaseExists(versions.replace("`", "")):
        return []
    shown = (shown_version(spark, table) or "").replace("`", "").lower()
    pattern = re.compile(re.escape(name) + "__[0-9a-f]{12}", re.IGNORECASE)
    dropped = []
    for found in spark.catalog.listTables(versions.replace("`", "")):
        version = f"{versions}.{found.name}"
        if pattern.fullmatch(found.name) and version.replace("`", "").lower() != shown:
            spark.sql(f"DROP TABLE IF EXISTS {version}")
            dropped.append(version)
    return sorted(dropped)


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop ``table``, view and versions; nothing happens where there is none."""
    if shown_version(spark, table):
        spark.sql(f"DROP VIEW {table}")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_old_versions(spark, table)


def read_tables(
    spark: SparkSession, names: Iterable[str], database: str | None = None
) -> tuple[dict[str, DataFrame], list[str]]:
    """Lazy frames of the tables that exist, and the names of those that do not."""
    found, absent = {}, []
    for name in names:
        full = f"{database}.{name}" if database else name
        if spark.catalog.tableExists(full):
            found[name] = spark.table(full)
        else:
            absent.append(name)
    return found, absent


def register_views(frames: dict[str, DataFrame]) -> None:
    """Make frames readable by name in SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A local session without the setting gets a temporary folder; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="fairshare-")
    return _local_dirs[context.applicationId]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later passes read columns from storage instead of running the whole lineage again, and a lost
    executor loses nothing.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/fairshare/{app}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
