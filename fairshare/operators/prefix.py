"""Running totals over a whole frame without gathering it in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.sources.tables import settle

BUCKET = "_bucket"


def running_total(
    df: DataFrame, order: Iterable[Column], value: str, into: str, buckets: int | None = None
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over all rows before this one in ``order``.

    ``order`` must be unique. Rows are range-partitioned by it, which splits ties too, and written
    once so that the buckets are fixed; a window sums within each bucket, and the totals of the
    buckets before are added by a join with one row per bucket.
    """
    order = list(order)
    conf = df.sparkSession.conf
    n = buckets or int(conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id()), "ordered"
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = before.orderBy(BUCKET)
    # one row per bucket, so at most n rows meet in the unpartitioned window and in the broadcast
    totals = placed.groupBy(BUCKET).agg(F.sum(value).alias("_sum"))
    offsets = totals.select(BUCKET, F.sum("_sum").over(before).alias("_offset"))
    inside = Window.partitionBy(BUCKET).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
        .join(F.broadcast(offsets), BUCKET)
        .withColumn(into, F.col("_inside") + F.coalesce("_offset", zero))
        .drop("_inside", "_offset", BUCKET)
    )
