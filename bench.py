"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from pathscreen import catalog
from pathscreen.session import local_session

QUERIES = (
    "flagship_calmar_ranking", "core_metrics", "psr", "trial_budget", "drop_top_k", "calendar_recurrence", "oos_gate", "equity_curve",
    "daily_compound", "benchmark_stats", "bootstrap_p5", "monte_carlo", "mc_bands", "random_control_bars", "random_control_events",
    "asof_exit_bar", "trades_to_daily", "overlap_reject", "top_contributors", "join_corr_fingerprint", "detect_asset", "coerce_numeric",
    "parse_dates", "pii_values", "preflight_report", "score_unified", "price_store_refresh",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in QUERIES:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
