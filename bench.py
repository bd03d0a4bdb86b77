"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Every query is executed in full
through the ``noop`` sink (nothing is collected to the driver); the reported time is
the median of ``$BENCH_REPEAT`` warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from detlens.plans import queries as Q  # noqa: E402
from detlens.session import drop_intermediate, get_session  # noqa: E402

HEADLINE = (
    "benchmark_metrics",
    "metric_across_runs",
    "confusion_columns",
    "next_word_model",
    "topk_next_word",
    "perplexity",
    "iob_tags",
    "missing_determiner",
    "extra_determiner",
    "annotate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(Q.REGISTRY) if wanted == "all" else [n for n in wanted.split(",") if n]
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "0")) or (int(cpus) if cpus.isdigit() else 8)
    spark = get_session(f"local[{cpus}]", parts, app="detlens-bench")
    # The local file is one row group; deal its rows out as the splits of a large table would be.
    spark.conf.set("detlens.scan.partitions", str(2 * parts))
    # Warm the JVM and the Python workers once.
    Q.benchmark_metrics(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        drop_intermediate(spark)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
    }))


if __name__ == "__main__":
    main()
