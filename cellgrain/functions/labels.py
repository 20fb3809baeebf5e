"""Threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: at or below this a number is treated as an error code.
ERROR_VALUE = -900.0


def tier(percentile: Column) -> Column:
    return (
        F.when(percentile >= 90, "top10")
        .when(percentile >= 75, "top25")
        .when(percentile >= 25, "middle")
        .when(percentile >= 10, "bottom25")
        .otherwise("bottom10")
    )


def tier_label(percentile: Column) -> Column:
    return (
        F.when(percentile >= 90, "前 10%")
        .when(percentile >= 75, "前 25%")
        .when(percentile >= 25, "中游")
        .when(percentile >= 10, "后 25%")
        .otherwise("后 10%")
    )


def box_zone(value: Column, q25: Column, median: Column, q75: Column) -> Column:
    """Where a value sits in the box plot."""
    return (
        F.when(value >= q75, "upper")
        .when(value >= median, "upper_middle")
        .when(value >= q25, "lower_middle")
        .when(value < q25, "lower")
    )


def correlation_strength(r: Column, strong: float = 0.7, moderate: float = 0.3) -> Column:
    return (
        F.when(F.abs(r) >= strong, "strong")
        .when(F.abs(r) >= moderate, "moderate")
        .otherwise("weak")
    )


def correlation_direction(r: Column) -> Column:
    return F.when(r > 0.01, "positive").when(r < -0.01, "negative").otherwise("none")


def outlier_strategy(value: Column, z: Column) -> Column:
    """Error codes are excluded, high z is marked; a strongly negative z is kept."""
    return F.when(value <= ERROR_VALUE, "auto-exclude").when(z > 3, "mark").otherwise("keep")


def outlier_class(value: Column) -> Column:
    return F.when(value > 0, "extremeHigh").otherwise("extremeLow")


def overrun_percent(direction: Column, distance: Column, upper: Column) -> Column:
    """How far a high candidate lies above the fence, in percent of the fence."""
    return F.when((direction == "high") & (upper > 0), F.try_divide(distance, upper) * 100.0)


def risk_level(unique_ratio: Column) -> Column:
    """Grouping risk of a dimension by its share of distinct values."""
    return (
        F.when(unique_ratio >= 0.95, "excluded")
        .when(unique_ratio >= 0.8, "warning")
        .otherwise("none")
    )
