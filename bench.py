"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 2); its time is the fastest of
these, from building the plan to the last row. Results go to the noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tapeledger.queries import registry  # noqa: E402
from tapeledger.session import local_session  # noqa: E402

HEADLINE = [
    "ea_summary", "ea_full_metrics", "ea_basic_metrics", "ea_drawdown", "ea_streaks", "ea_by_symbol",
    "ea_equity_curve", "ea_streak_runs", "ea_best_worst_buckets", "ea_by_month", "ea_daily_calendar",
    "account_overview", "account_strategies", "account_equity_curve", "dashboard_totals",
    "trades_enriched", "ingest_validate", "snapshot_upsert", "symbol_full_metrics_cut",
    "account_equity_curve_cut",
]
# timed once each and reported beside the total, which stays comparable over the rounds
MORE = [
    "ingest_new_trades", "ingest_status", "stream_ingest", "stream_metrics", "stream_metrics_batches",
    "running_metrics", "running_metrics_late", "ea_report_json", "ea_curve_pages", "ea_labels",
]


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark, queries = local_session(cpus, "bench"), registry()
    seconds = {}
    # the first queries also warm up the JVM itself
    for _ in range(3):
        timed(queries[HEADLINE[0]], spark, sf_dir)
    for name in HEADLINE:
        timed(queries[name], spark, sf_dir)
        seconds[name] = round(min(timed(queries[name], spark, sf_dir) for _ in range(runs)), 3)
    more = {name: round(timed(queries[name], spark, sf_dir), 3) for name in MORE}
    scale = Path(sf_dir).name.removeprefix("sf")
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "more_queries": more,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
