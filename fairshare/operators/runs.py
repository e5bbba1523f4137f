"""A record of model runs, and the fitted models as tables."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairshare.operators.forest import StoredForest
from fairshare.operators.peers import PeerModel
from fairshare.operators.scaling import Scaler


def run_log(
    spark: SparkSession,
    run: str,
    params: dict[str, Any],
    metrics: dict[str, float | None],
    run_id: str | None = None,
    started: datetime | None = None,
) -> DataFrame:
    """(run_id, started, run, kind, key, value, number): parameters as text, metrics also as numbers.

    Without ``run_id`` and ``started`` a new id and the present time are taken.
    """
    same = run_id or uuid4().hex, started or datetime.now(timezone.utc), run
    rows = [(*same, "param", k, str(v), None) for k, v in params.items()]
    rows += [
        (*same, "metric", k, str(v), None if v is None else float(v)) for k, v in metrics.items()
    ]
    return spark.createDataFrame(
        rows,
        "run_id string, started timestamp, run string, kind string, key string, value string, "
        "number double",
    )


def append_runs(log: DataFrame, table: str, fmt: str = "parquet") -> None:
    """Add the runs of ``log``, in place of what ``table`` holds of the same ``run_id``.

    The table is partitioned by run, and only partitions of the written runs are replaced, so a write
    that is tried again adds nothing twice. A table that is not partitioned is appended to.
    """
    spark = log.sparkSession
    if not spark.catalog.tableExists(table):
        log.repartition("run_id").write.format(fmt).partitionBy("run_id").saveAsTable(table)
        return
    if not any(c.isPartition for c in spark.catalog.listColumns(table)):
        log.coalesce(1).write.format(fmt).mode("append").saveAsTable(table)
        return
    columns = [c for c in spark.table(table).columns if c != "run_id"]
    for (run,) in log.select("run_id").distinct().collect():
        named = run.replace("\\", "\\\\").replace("'", "\\'")
        own = log.where(F.col("run_id") == run).select(*columns).coalesce(1)
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (run_id = '{named}') SELECT * FROM {{own}}", own=own)


def scaler_frame(spark: SparkSession, scaler: Scaler) -> DataFrame:
    rows = zip(scaler.columns, scaler.means, scaler.deviations)
    rows = [(i, c, m, s, scaler.rows) for i, (c, m, s) in enumerate(rows)]
    return spark.createDataFrame(
        rows, "position int, column string, mean double, deviation double, rows long"
    )


def scaler_from(frame: DataFrame) -> Scaler:
    rows = frame.orderBy("position").collect()
    return Scaler(
        [r["column"] for r in rows],
        rows[0]["rows"],
        [r["mean"] for r in rows],
        [r["deviation"] for r in rows],
    )


def peers_frame(spark: SparkSession, model: PeerModel) -> DataFrame:
    rows = [
        (i, model.columns, [float(v) for v in center], model.inertia, model.steps, model.converged)
        for i, center in enumerate(model.centers)
    ]
    return spark.createDataFrame(
        rows,
        "cluster_id int, columns array<string>, center array<double>, inertia double, steps int, "
        "converged boolean",
    )


def peers_from(frame: DataFrame) -> PeerModel:
    rows = frame.orderBy("cluster_id").collect()
    first = rows[0]
    centers = np.array([r["center"] for r in rows])
    # tables written before the flag was kept do not tell
    converged = first["converged"] if "converged" in frame.columns else False
    return PeerModel(list(first["columns"]), centers, first["inertia"], first["steps"], converged)


def forest_frame(stored: StoredForest) -> DataFrame:
    """The trees, each with the fit's row count, sample size and threshold."""
    return stored.trees.withColumns(
        {
            "fitted_rows": F.lit(stored.rows).cast("long"),
            "sample": F.lit(stored.sample),
            "score_threshold": F.lit(stored.threshold).cast("double"),
        }
    )


def forest_from(frame: DataFrame) -> StoredForest:
    first = frame.select("fitted_rows", "sample", "score_threshold").first()
    trees = frame.drop("fitted_rows", "sample", "score_threshold")
    return StoredForest(trees, *first)
