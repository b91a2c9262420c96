"""Headline queries, timed to a noop sink; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3; the
best run counts), BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeframe import build_session  # noqa: E402
from tapeframe.plans import registry  # noqa: E402
from tapeframe.session import fresh_folder  # noqa: E402
from tapeframe.sources import lake, views  # noqa: E402

HEADLINE = (
    "quote_feature_table", "trade_feature_table", "unified_feature_timeline", "replay_statistics",
    "sequence_status", "asof_backward", "forward_return_labels", "triple_barrier_labels",
    "purged_k_fold", "combinatorial_purged", "regulatory_fees", "running_cash_position",
    "average_cost_pnl", "l2_depth", "bbo_timeline", "quote_decisions", "rebalance_signals",
    "partition_stats",
)


def write_trades(spark, sf):
    """The contracted zstd write alone, without the manifest."""
    root = fresh_folder(spark, "bench")
    views.trades(spark, sf).write.option("compression", "zstd").parquet(f"{root}/trades")
    return root


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        f"local[{cpus}]", "tapeframe-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    timed: dict[str, float] = {}

    def clock(name, action):
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            action()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        timed[name] = round(best, 3)

    for name in names:
        clock(name, lambda q=queries[name]: q(spark, sf).write.format("noop").mode("overwrite").save())
    if len(names) == len(HEADLINE):
        root = write_trades(spark, sf)
        clock("parquet_write", lambda: write_trades(spark, sf))
        clock("parquet_read", lambda: spark.read.parquet(f"{root}/trades").write.format("noop")
              .mode("overwrite").save())
        lake.write_dataset(views.trades(spark, sf), root, "audited", partition_by=())
        clock("integrity_audit", lambda: lake.verify_integrity(spark, root, "audited").collect())
    print(json.dumps({
        "metric": "headline query seconds, summed", "value": round(sum(timed.values()), 3),
        "unit": "sec", "queries": timed, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
