"""Registered queries over the test tables, each with its DuckDB twin where SQL can say it."""

from catalog import cells, distributions, grouping, profiling, records, statistics, timeline  # noqa: F401
from catalog.base import ORACLES, QUERIES, at_scale

# The same queries planned for a table too large for one task.
for _name in (
    "numeric_summary", "metric_stats", "metrics_batch", "group_by_dimension", "group_by_many_keys", "outlier_status",
    "outliers_mad", "rank_interval", "cdf", "positions_of_inputs", "row_numbers", "row_numbers_tied", "quartile_segments", "record_profiles", "median_deviations",
):
    at_scale(_name)

__all__ = ["ORACLES", "QUERIES"]
