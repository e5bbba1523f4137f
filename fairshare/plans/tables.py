"""Raw frames to the four served tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fairshare.operators import forest as iforest
from fairshare.operators import peers, runs
from fairshare.operators.aggregates import (
    contributions_by_fund_year,
    disasters_by_country,
    needs_by,
    population_by,
    requirements_base,
)
from fairshare.operators.features import build_features
from fairshare.operators.quantile import exact_quantile
from fairshare.operators.scaling import ML_FEATURES, Scaler, fit_scaler, ml_ready
from fairshare.operators.serving import anomaly_summary
from fairshare.plans import prep
from fairshare.sources.tables import ensure_database, read_tables, settle, write_table

RAW = ["hno", "fts_requirements", "population", "projects", "contributions", "emdat"]
SCALED = "_z_"


def features_table(raw: dict[str, DataFrame], since_year: int = 2019) -> DataFrame:
    """The feature table from raw requirements, needs, population and disasters."""
    return build_features(
        requirements_base(prep.prep_requirements(raw["fts_requirements"])),
        needs_by(prep.prep_needs(raw["hno"])),
        population_by(prep.prep_population(raw["population"])),
        disasters_by_country(prep.prep_disasters(raw["emdat"]), since_year),
    )


def contributions_table(raw: dict[str, DataFrame]) -> DataFrame:
    return contributions_by_fund_year(prep.prep_contributions(raw["contributions"]))


def projects_table(raw: dict[str, DataFrame]) -> DataFrame:
    return prep.prep_projects(raw["projects"])


def build_tables(
    spark: SparkSession, database: str, fmt: str = "parquet", prefix: str = "raw_"
) -> list[str]:
    """Read ``raw_*`` tables, write ``features``, ``projects`` and ``contributions``.

    A table whose sources are absent is skipped; returns the names written.
    """
    ensure_database(spark, database)
    found, _ = read_tables(spark, [prefix + name for name in RAW], database)
    raw = {name.removeprefix(prefix): df for name, df in found.items()}
    needed = {
        "features": (features_table, {"fts_requirements", "hno", "population", "emdat"}),
        "projects": (projects_table, {"projects"}),
        "contributions": (contributions_table, {"contributions"}),
    }
    written = []
    for name, (build, sources) in needed.items():
        if sources <= raw.keys():
            write_table(build(raw), f"{database}.{name}", fmt)
            written.append(name)
    return written


@dataclass(frozen=True)
class Models:
    """What a modelling run leaves behind."""

    anomalies: DataFrame
    scaler: Scaler
    forest: iforest.StoredForest
    settings: dict[str, Any]
    peer_model: peers.PeerModel
    sweep: list[tuple[int, float, float | None]]


def scored_rows(
    features: DataFrame,
    trees: int = iforest.TREES,
    contamination: float = iforest.CONTAMINATION,
    seed: int = iforest.SEED,
) -> tuple[DataFrame, iforest.StoredForest, Scaler]:
    """(scored rows, forest, scaler): the model-ready rows with their score and flag."""
    ready = settle(ml_ready(features), "ready")
    scaler = fit_scaler(ready)
    trained = settle(iforest.fit_forest(ready, scaler.rows, trees=trees, seed=seed), "forest")
    scored = settle(iforest.score(ready, trained, scaler.rows), "scored")
    threshold = exact_quantile(scored, "raw_score", 1.0 - contamination)
    stored = iforest.StoredForest(trained, scaler.rows, iforest.SAMPLE, threshold)
    return iforest.flag_above(scored, "raw_score", threshold), stored, scaler


def detect(features: DataFrame, **settings) -> DataFrame:
    """Model-ready rows with ``is_anomaly`` and ``anomaly_score``."""
    scored, _, _ = scored_rows(features, **settings)
    return scored.drop("raw_score")


def model(
    features: DataFrame,
    ks: Iterable[int] = peers.KS,
    restarts: int = peers.RESTARTS,
    **settings,
) -> Models:
    """Score anomalies and group peers; the anomalies frame carries ``cluster_id``.

    The frame labels its rows when it is read; ``publish_models`` writes it as a table.
    """
    scored, trained, scaler = scored_rows(features, **settings)
    columns = [SCALED + c for c in ML_FEATURES]
    scaled = scaler.transform(scored, SCALED)
    fitted = peers.fit_peers(scaled, scaler.rows, columns, ks=ks, restarts=restarts)
    found = peers.sweep(scaled, scaler.rows, fitted)
    best = fitted[peers.best_k(found)]
    labelled = peers.label_rows(scaled, best).drop("raw_score", *columns)
    defaults = {"contamination": iforest.CONTAMINATION, "trees": iforest.TREES}
    return Models(labelled, scaler, trained, defaults | settings, best, found)


def publish_models(
    spark: SparkSession,
    database: str,
    models: Models,
    fmt: str = "parquet",
    run_id: str | None = None,
) -> None:
    """Write the anomalies table, the fitted models, and the run log with the settings of the fit.

    With a ``run_id`` publishing again replaces the log of that run; without one it is a new run.
    """
    ids = {name: run_id and f"{run_id}-{name}" for name in ("isolation_forest", "kmeans_benchmarking")}
    started = datetime.now(timezone.utc)
    write_table(models.anomalies, f"{database}.anomalies", fmt)
    write_table(runs.forest_frame(models.forest), f"{database}.model_forest", fmt)
    write_table(runs.scaler_frame(spark, models.scaler), f"{database}.model_scaler", fmt)
    write_table(runs.peers_frame(spark, models.peer_model), f"{database}.model_peers", fmt)
    flagged = anomaly_summary(spark.table(f"{database}.anomalies")).first()
    silhouette = {k: s for k, _, s in models.sweep}[models.peer_model.k]
    log = runs.run_log(
        spark,
        "isolation_forest",
        {
            "contamination": models.settings["contamination"],
            "n_estimators": models.settings["trees"],
            "n_features": len(models.scaler.columns),
        },
        {"anomaly_count": flagged["anomaly_count"], "anomaly_rate": flagged["anomaly_rate"]},
        ids["isolation_forest"],
        started,
    ).union(
        runs.run_log(
            spark,
            "kmeans_benchmarking",
            {"n_clusters": models.peer_model.k, "converged": models.peer_model.converged},
            {"inertia": models.peer_model.inertia, "silhouette_score": silhouette},
            ids["kmeans_benchmarking"],
            started,
        )
    )
    runs.append_runs(log, f"{database}.runs", fmt)
