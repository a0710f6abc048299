"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is built and fully executed into Spark's no-op sink (no driver
collect); the time covers both, since some builds run jobs eagerly (chunk
planning, model fitting, streaming runs).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans.catalog import REGISTRY  # noqa: E402
from vigil.session import get_spark  # noqa: E402

HEADLINE = (
    "mad_stats",                # detector, every point (events)
    "mad_lineitem",             # detector over 1,000 supplier series (lineitem)
    "mad_chunked",              # skew-safe chunked plan with halos
    "mad_stale_reset",          # idle-gap resets
    "anomaly_events",           # detect + stamp
    "envelope_roundtrip",       # encode -> decode
    "dedup_first",              # first-wins dedup
    "series_state",             # latest state per series
    "list_anomalies",           # end-to-end flagship page
    "stream_mad",               # streaming detector (transformWithState)
    "reconstruction_mse",       # scoring
    "mad_stats_numpy",          # same detector, numpy engine (comparison)
    "mad_lineitem_numpy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    # JVM / codegen warm-up outside the timed section (one tiny job)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()  # build is timed too: some plans run jobs eagerly
        df = REGISTRY[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
