"""Time the headline queries and print one JSON line.

Tables come from ``$BENCH_SF_DIR``; the session is ``local[$BENCH_CPUS]``. Every query is run to
its last row. Queries on stored tables are timed apart from the builds that store them.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from checks import queries as q
from fairshare.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP = "/root/testdata/sf0.001"

HEADLINE = [
    "coerce_orders", "prep_requirements", "merged_requirements", "contributions_by_fund_year",
    "disasters_by_country", "feature_table",
    "null_profile", "range_check", "duplicate_keys_unmerged", "issues",
    "kpis_filtered", "gap_by_country", "coverage_heatmap", "top_funds",
    "allocate_impact", "allocation_totals",
    "flag_by_contamination", "scaled_features", "label_silhouette", "peer_benchmark",
    "anomalies", "top_anomalies", "peer_sweep",
]
BUILDS = {
    "build_features": q.feature_rows,
    "build_contributions": q.contribution_rows,
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session("bench")
    if Path(WARM_UP).exists():
        run(q.QUERIES["gap_by_country"](spark, WARM_UP))
    seconds = {}
    for name, build in BUILDS.items():
        started = time.perf_counter()
        build(spark, SF_DIR)
        seconds[name] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        run(q.QUERIES[name](spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
