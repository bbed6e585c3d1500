"""Benchmark: headline queries and a whole run, as one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores. Times are the median
of BENCH_REPEATS runs (default 3) after one warm-up; results go to a no-op sink, so every row is
computed and none is collected. The whole run starts from a Parquet file of sales lines, as a
user's upload would be, and materialises its KPI values, findings and verdict.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from metricloom.plans import suite, views
from metricloom.plans.queries import QUERIES
from metricloom.session import local_session

HEADLINE = [
    "kpi_scalar_suite", "kpi_by_segment", "kpi_series_quarter", "kpi_series_daily", "kpi_multi_table", "kpi_median_total",
    "slice_filters", "filter_options", "date_granularity", "pii_scan", "join_candidates_fresh", "clean_fresh",
    "infer_decisions", "returns_convention", "linear_trend", "pareto", "correlation", "domain_inference",
]


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fresh(name):
    """Queries that would reuse a settled result within a session are timed from scratch."""
    from metricloom.operators import clean, joins
    from metricloom.plans import queries

    if name == "join_candidates_fresh":
        return lambda spark, folder: joins.discover_joins(queries.join_views(spark, folder))
    if name == "clean_fresh":
        steps = [clean.Step("drop_duplicates", "orders"), clean.Step("trim_whitespace", "orders", "status"),
                 clean.Step("empty_to_null", "orders", "status")]
        return lambda spark, folder: clean.execute_plan({"orders": queries.messy(spark, folder)}, steps)[0]["orders"]
    return QUERIES[name]


def timed(run, repeats: int) -> float:
    run()
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = sys.argv[1:]
    spark = local_session(cores, "bench")
    results = {}
    for name in HEADLINE:
        if not only or name in only:
            run = fresh(name)
            results[name] = timed(lambda: sink(run(spark, folder)), repeats)
    if not only or "full_run" in only:
        path = tempfile.mkdtemp(prefix="metricloom-bench-") + "/sales.parquet"
        views.sales(spark, folder).repartition(int(cores)).write.parquet(path)

        def whole() -> None:
            found = suite.run_suite({"sales": spark.read.parquet(path)}, "retail", "retail",
                                    overrides={"event_date": "sales.order_ts"})
            for part in ("kpi_values", "insights", "verdict"):
                sink(found[part])

        results["full_run"] = timed(whole, 1)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": os.path.basename(folder.rstrip("/")), "cores": int(cores),
    }))


if __name__ == "__main__":
    main()
