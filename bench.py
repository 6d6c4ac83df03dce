"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandlake import plans  # noqa: E402
from demandlake.session import get_session  # noqa: E402

HEADLINE = (
    "a1_weekly_demand",
    "a2_monthly_demand",
    "a4_consistency_audit",
    "a7_calendar_features",
    "j1_feature_table",
    "w3_rolling_stats",
    "p17_tree_input",
    "backtest_seasonal_naive",
    "a19_pooled_metrics",
    "m10_ljung_box",
    "w14_production_champion",
    "j4_future_frame",
    "m15_canonical_forecast",
    "m3_structural_backtest",
    "m4_autoregressive_backtest",
    "m5_tree_backtest",
    "m24_candidate_study",
    "m20_weekly_backtest",
    "h3_mint_shrink",
    "c1_chunks",
    "c2_nearest_chunks",
    "c6_context_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    names = sys.argv[1:] or HEADLINE
    # Start the session and the Python workers before the clock runs.
    queries["backtest_seasonal_naive"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
