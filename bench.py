"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the no-op sink (full execution, nothing
collected to the driver).  Times include planning and any build-once work the
query triggers (the vocabulary is learned by ``vocab_learn`` first and reused).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "crawl_size",
    "host_tally",
    "exchange_assembly",
    "exchange_projection",
    "charset_resolve",
    "btrim",
    "strim",
    "block_packing",
    "truncate_pad",
    "auto_split",
    "metrics_by_group",
    "asof_snapshot",
    "trial_outliers",
    "vocab_learn",
    "tokenize",
    "vocab_learn_html",
    "lm_blocks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from corpusforge.plans.catalog import all_queries
    from corpusforge.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(int(cpus), 8))
    qs = all_queries()
    # warm the JVM and the Python workers (Arrow UDF path) on a trivial scan
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def _touch(v):
        return v

    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    region.write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, int(cpus)).select(_touch("id")).write.format("noop").mode("overwrite").save()
    times: dict[str, float | None] = {}
    failed: dict[str, str] = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        try:
            df = qs[name].build(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # record and go on: one failure must not lose the other timings
            times[name] = None
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
