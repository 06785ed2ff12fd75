"""Benchmark: the mart build and every business question at one scale.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per job), "sf"}. The mart (B1: four aggregates, three joins, the
cleaning) runs once as a query and is then built and written, as the original
stores its summary table; every later job reads that stored table. Each job runs to completion
through the ``noop`` sink (results are not shipped to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vendorscope.operators.summary import vendor_sales_summary  # noqa: E402
from vendorscope.plans.context import VendorContext  # noqa: E402
from vendorscope.plans.registry import REGISTRY, _load  # noqa: E402
from vendorscope.session import get_session  # noqa: E402
from vendorscope.sources.fixtures import vendor_sources  # noqa: E402

# headline jobs: the mart, then B2-B13 and the profile of B11
HEADLINE = [
    "brand_thresholds", "target_brands", "top_vendors_sales", "top_brands_sales", "vendor_pareto",
    "vendor_dependency", "unit_price_by_order_size", "boxplot_by_order_size", "slow_vendors",
    "unsold_total", "unsold_by_vendor", "margin_ci", "welch_test", "describe", "correlation",
    "histogram", "kde", "kde_binned", "boxplot", "category_counts", "anomaly_profile", "key_uniqueness",
    "table_profile", "purchases_by_brand_price", "sales_by_brand", "distinct_po", "null_profile",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = get_session(cpus, cpus, app_name="vendorscope-bench")
    _load()
    times: dict[str, float] = {}

    # JVM warm-up (class loading, JIT of the shuffle path) on a trivial job:
    # reported, not counted in the total
    t0 = time.perf_counter()
    spark.range(0, 100_000, numPartitions=cpus).groupBy((F.col("id") % 7).alias("k")).count().collect()
    warmup = time.perf_counter() - t0

    t0 = time.perf_counter()
    ctx = VendorContext(spark, vendor_sources(spark, sf_dir))
    s = ctx.sources                  # B1 as one query, nothing stored but the price list
    run(vendor_sales_summary(s.purchases, s.purchase_prices, s.vendor_invoice, s.sales, totals=s.purchase_totals))
    times["vendor_summary_query"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    ctx.summary                      # B1: build + store the mart
    times["vendor_summary_build"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    ctx.analysis                     # the analysed frame with order sizes, stored
    times["analysis_frame_build"] = time.perf_counter() - t0

    for name in HEADLINE:
        t0 = time.perf_counter()
        run(REGISTRY[name].build(ctx))
        times[name] = time.perf_counter() - t0

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "vendor_analytics_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": sf,
        "cpus": cpus,
        "warmup_sec": round(warmup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
