"""Wall time of the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the cores. With
`--all` every registered query is timed. Streams count from start to the last batch.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardflow.plans import registry  # noqa: E402
from wardflow.session import build_session  # noqa: E402

HEADLINE = [
    "flow_features", "join_flow_windows", "agg_context", "join_context_asof", "census_interval_join",
    "census_running", "avg_wait_time", "los_deviation", "feature_vector", "transfer_counts",
    "edge_weights", "neighbor_mean", "graph_attention", "sequence_24", "history_attention",
    "training_set", "persistence_forecast", "evaluate_forecasts", "drift_status", "alert_resolution",
    "sink_predictions", "validate_events", "stream_patient_windows", "stream_context_windows",
    "sink_feature_store", "join_context_interval",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")})
    queries, _ = registry.load()
    names = list(queries) if "--all" in sys.argv else HEADLINE
    queries["flow_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    took = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    speed = {n: round(rows / took[n]) for n in took if n.startswith("stream_") and n.endswith("_windows")}
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "events_per_sec": speed}))
    spark.stop()


if __name__ == "__main__":
    main()
