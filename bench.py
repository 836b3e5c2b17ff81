"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated list. Each query's whole result is computed through the `noop` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "score_to_decision", "attack_indicators", "fuse_consensus", "specialist_boost", "explain_alert",
    "overview_stats", "alert_categories", "alert_timeline", "top_talkers", "confusion", "class_thresholds",
    "protocol_entropy", "near_miss", "ip_window_score", "repeat_alerts", "distributed_attack", "multi_stage",
    "correlate", "rule_match", "rolling_stats", "zscore_anomaly", "baseline_ewma", "segment_summary",
    "decision_fsm", "cooldown_filter", "similar_context", "signature_match", "campaigns", "flow_to_event",
    "ingest_events", "packet_decode", "payload_entropy", "decision_stream", "top_correlated_sources", "detect_alerts",
)


def main() -> None:
    from vigilflow import catalog
    from vigilflow.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, app="vigilflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # also starts the executors
    queries, seconds = catalog.queries(), {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:26s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "events": events,
        "events_per_sec": {n: round(events / s) for n, s in seconds.items() if s > 0},
    }))


if __name__ == "__main__":
    main()
