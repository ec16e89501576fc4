"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The session is warmed up by one small scan; then each query is timed once, end to end (build, plan,
execute, all rows and columns) through the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from stockweave.queries import QUERIES
from stockweave.session import build_session

HEADLINE = (
    "observed_grid",
    "unpivot_daily_sales",
    "validate_table",
    "sink_parquet_verified",
    "content_fingerprint",
    "calibrate_profiles",
    "scenario_demand",
    "sample_demand",
    "build_operations",
    "forecast_seasonal_naive",
    "backtest_accuracy",
    "training_set",
    "forecast_ml",
    "stock_ledger_rollforward",
    "inventory_kpis",
    "policy_scorecard",
    "levels_safety_stock",
    "levels_order_up_to",
    "order_recommendation",
    "metric_delta_vs_base",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "stockweave-bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            # Test tables compress to well under the 1 MB default, which would leave one task per shuffle.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["time_range"](spark, path).collect()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
