"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then three times into a sink that discards the rows; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hashmark.catalog import QUERIES  # noqa: E402
from hashmark.session import local_session  # noqa: E402

HEADLINE = (
    "team_period_stats", "team_form", "rolling_multi", "game_side_summary", "team_season_means",
    "join_both_sides", "join_form_both_sides", "recent_form", "rest_days", "team_feature_frame",
    "score_models", "bet_sizing", "backtest_by_season", "compare_models", "edge_threshold_table", "roi_by_edge_bin",
    "kelly_by_threshold", "backtest_summary", "predictor_scorecard", "cumulative_ev", "describe_columns",
    "fit_ridge", "cv_ridge_time", "price_quotes", "closing_line_asof", "clv_report", "run_quality_suite", "upsert_period",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
