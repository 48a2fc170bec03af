"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS -> one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ohlcv_bars",
    "volume_delta_vwap",
    "ema9",
    "rolling_volatility",
    "relative_strength_asof",
    "pit_replay_features",
    "quote_quality",
    "coverage_status",
    "extended_scores",
    "barrier_outcomes",
    "shadow_outcomes",
    "universe_select",
    "bar_metrics",
    "scd2_membership",
    "cohort_20_5_5",
    "rank_all",
    "weight_ablation",
    "daily_decision",
    "context_dedupe",
    "context_scores",
    "outcome_metrics",
    "ablation_report",
    "walk_forward_model",
    "cash_ledger",
    "daily_evaluation",
    "monitor_5min",
]


def main() -> None:
    from tidemark.registry import QUERIES
    from tidemark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/events.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        # The whole result is computed, but not shipped to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
