"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "parse_number_dirty", "parse_date_dirty", "row_classes", "filter_numeric_ops", "ragged_rows",
    "numeric_summary", "metric_stats", "metrics_batch", "position_higher", "positions_of_inputs",
    "group_by_dimension", "group_by_many_keys", "group_dirty", "correlation_pairs", "outlier_status",
    "outlier_records", "mean_change", "histogram", "quartile_segments", "cdf", "rank_interval",
    "time_series", "time_series_quality", "prev_day_comparison", "systematic_sample", "row_numbers",
    "column_profile", "document_profile", "infer_schema_orders", "legacy_fields_customer",
    "dataset_overview", "dataset_profile", "lookup_many", "lookup_cascade", "locator_report", "fingerprint",
    # the same queries as planned for a table too large for one task
    "numeric_summary_at_scale", "metrics_batch_at_scale", "group_by_dimension_at_scale", "group_by_many_keys_at_scale",
    "outlier_status_at_scale", "rank_interval_at_scale", "cdf_at_scale", "positions_of_inputs_at_scale", "row_numbers_at_scale",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the JVM's compilers on a query that is not timed
    QUERIES["min_max"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
