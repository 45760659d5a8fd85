"""Headline queries at one scale: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridgeflow.catalog import all_checks  # noqa: E402
from ridgeflow.session import local_session  # noqa: E402

HEADLINE = (
    "stop_runs",
    "blocks_and_smoothing",
    "realized_distance",
    "time_at_distance",
    "asof_last_purchase",
    "interval_union_cover",
    "grid_resample_smooth",
    "pace_lookup_projection",
    "grade_bins_curve",
    "rank_quantiles",
    "support_metrics",
    "usage_target",
    "calibration_beta",
    "band_quantiles",
    "rolling_robust_normal",
    "export_merge",
    "zigzag_climbs",
    "jaccard_best_match",
    "drift_slope",
    "within_group_ols",
    "cr2_cov",
    "lag_autocorrelation",
    "route_groups",
    "matched_points",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    checks = all_checks()
    seconds: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    for name in HEADLINE:
        started = time.perf_counter()
        checks[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
