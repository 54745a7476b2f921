"""Benchmark: time the headline query keys at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed into Spark's ``noop`` sink (no driver collect).  Prints one
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kpi_compare", "decompose_device", "decompose_product", "decompose_all_dimensions",
    "decompose_each_dimension_separately",
    "root_cause_candidates", "funnel_compare", "leading_segment_funnel", "traffic_candidates",
    "attribution_compare", "campaign_candidates", "review_topic", "experiment_lift",
    "incidents_scoped", "session_facts", "batch_kpi_compare", "batch_decompose",
    "report_claims", "constraint_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    from shiftscope.session import local_session
    from shiftscope.queries import REGISTRY, ORDERS_PERIODS
    from shiftscope.sources import tpch_adapter as A
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus))),
                          app="shiftscope-bench")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def all_dims(spark_, sf):
        from shiftscope.operators.decompose import DIMENSIONS, decompose
        return decompose(A.orders_tables(spark_, sf), ORDERS_PERIODS, list(DIMENSIONS))

    def each_dim(spark_, sf):
        # one query per dimension, as a per-dimension API would run them (6 jobs)
        from shiftscope.operators.decompose import DIMENSIONS, decompose
        t = A.orders_tables(spark_, sf)
        for d in DIMENSIONS[:-1]:
            run(decompose(t, ORDERS_PERIODS, [d]))
        return decompose(t, ORDERS_PERIODS, [DIMENSIONS[-1]])

    extra = {"decompose_all_dimensions": all_dims, "decompose_each_dimension_separately": each_dim}
    run(REGISTRY["kpi_period"](spark, sf_dir))  # warm-up: JVM, parquet footers, codegen caches
    timings = {}
    for k in keys:
        fn = extra.get(k) or REGISTRY[k]
        t0 = time.perf_counter()
        run(fn(spark, sf_dir))
        timings[k] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    # reported, not part of the total: a comparison run, and the batch job whose work is
    # (number of requests) x (data per request)
    compare_only = {"decompose_each_dimension_separately", "batch_kpi_compare", "batch_decompose",
                    "report_claims", "constraint_audit"}
    extra_metrics = {}
    if "batch_kpi_compare" in timings:
        from shiftscope.sources import tpch_adapter as A2
        from shiftscope.plans.questions import SCOPE_FIELDS, question_scope, request_errors
        requests = A2.requests(A2.Raw(spark, sf_dir))
        valid = request_errors(requests).filter("valid").select("request_id")
        # requests with the same periods and scope are one investigation
        distinct = (requests.join(valid, "request_id").join(question_scope(requests), "request_id")
                    .select("current_start", "current_end", "previous_start", "previous_end", *SCOPE_FIELDS).distinct().count())
        extra_metrics = {"batch_requests": valid.count(), "batch_distinct_investigations": distinct,
                         "batch_ms_per_distinct_investigation": round(1000 * timings["batch_kpi_compare"] / max(distinct, 1), 2)}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(v for k, v in timings.items() if k not in compare_only), 3), "unit": "sec",
        "queries": timings, "sf": float(m.group(1)) if m else sf_dir, **extra_metrics,
        "spark": spark.version, "cpus": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
