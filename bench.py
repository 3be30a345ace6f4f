"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventlens.plans.queries import QUERIES  # noqa: E402
from eventlens.session import build_session  # noqa: E402

HEADLINE = [
    "window_scan",
    "window_glob",
    "latest_event_time",
    "hot_window",
    "current_state",
    "describe_sources",
    "parse_payloads",
    "admit_batches",
    "normalize_seq",
    "validate_semantic",
    "dedupe_first",
    "route_messages",
    "sweep_reasons",
    "sweep_report",
    "hash_embed",
    "search_topk",
    "search_filtered",
    "search_many",
    "search_hydrated",
    "federated_state",
    "rate_limit_turns",
    "effective_retention_many",
    "sweep_reasons_ranges",
    "stream_latest",
]
#: The table whose rows a query works through, where that is not `events`.
INPUT = {
    "parse_payloads": "conversations",
    "admit_batches": "conversations",
    "rate_limit_turns": "conversations",
    "hash_embed": "documents",
    "search_many": "documents",
    "search_topk": "embeddings",
    "search_filtered": "embeddings",
}
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    inputs = {n: INPUT.get(n, "events") for n in names}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(inputs.values())}
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):  # the first run warms the JVM and the page cache
            begin = time.perf_counter()
            # every row is computed, none is brought to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {n: round(rows[inputs[n]] / s) for n, s in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
