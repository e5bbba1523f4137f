"""Running totals within groups of any size: no group, however large, meets in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.sources.tables import settle

BUCKET, AT = "_bucket", "_at"


def in_order(df: DataFrame, order: Iterable[Column], keep: Iterable[Column], name: str) -> DataFrame:
    """Columns ``keep`` of ``df`` with the place of every row in ``order``, written to the shared folder.

    Rows are range-partitioned, and equal rows parted by their place in the input, so a value that
    repeats is split too. ``_bucket`` is the range, ``_at`` grows along the order.
    """
    order = [*order, F.col("_tie")]
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(buckets, *order)
    placed = ranged.sortWithinPartitions(*order)
    at = [F.spark_partition_id().alias(BUCKET), F.monotonically_increasing_id().alias(AT)]
    return settle(placed.select(*keep, *at), name)


def running(placed: DataFrame, group: str, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``placed``, as ``in_order`` gives it by ``group`` first, with totals up to and with each row.

    ``totals`` maps a new column to (column, "sum" or "xor"). Windows run within a bucket; only the
    first and the last group of a bucket can lie in others too, so what earlier buckets hold of
    them is at most two rows a bucket, which are broadcast.
    """
    fold = {"sum": F.sum, "xor": F.bit_xor}
    parts = {into: fold[how](column) for into, (column, how) in totals.items()}
    ends = placed.groupBy(BUCKET).agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
    crossing = placed.join(F.broadcast(ends), BUCKET).where(F.col(group).isin(F.col("_first"), F.col("_last")))
    crossing = crossing.groupBy(BUCKET, group).agg(*[p.alias(into) for into, p in parts.items()])
    before = Window.partitionBy(group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    passed = crossing.select(BUCKET, group, *[fold[how](into).over(before).alias(f"_b_{into}") for into, (_, how) in totals.items()])
    passed = passed.where(F.col(f"_b_{next(iter(totals))}").isNotNull())
    upto = Window.partitionBy(BUCKET, group).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({into: p.over(upto) for into, p in parts.items()})
    joined = inside.join(F.broadcast(passed), [BUCKET, group], "left")
    for into, (_, how) in totals.items():
        earlier = F.coalesce(f"_b_{into}", F.lit(0))
        joined = joined.withColumn(into, F.col(into) + earlier if how == "sum" else F.col(into).bitwiseXOR(earlier))
    return joined.drop(*[f"_b_{into}" for into in totals])
