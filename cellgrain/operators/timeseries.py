"""Time series of one value, daily totals and day-over-day comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.functions.text import trimmed
from cellgrain.operators.cells import number_of, text_of, time_ms_of

DAY_MEASURES = ("total_sales", "total_orders", "total_customers", "total_quantity", "avg_order_value")


def _points(df: DataFrame, time_field: str, value_field: str, row_id: str) -> DataFrame:
    return df.select(
        F.col(row_id),
        time_ms_of(df, time_field).alias("ms"),
        trimmed(text_of(df, time_field)).alias("date_label"),
        number_of(df, value_field).alias("value"),
    )


def time_series(
    df: DataFrame, time_field: str, value_field: str, row_id: str = "_row_id", ordered: bool = True
) -> DataFrame:
    """Rows with a valid date in time order; equal times keep row order; no aggregation.

    Unusable values stay as null.  The order is a range-partitioned sort.
    """
    points = _points(df, time_field, value_field, row_id).where("ms IS NOT NULL")
    return points.orderBy("ms", row_id) if ordered else points


def time_series_quality(
    df: DataFrame, time_field: str, value_field: str, row_id: str = "_row_id"
) -> DataFrame:
    """Counts of invalid dates, invalid values and repeated times.

    Rows are merged per time first, so a time shared by many rows is one group of
    partial counts.
    """
    per_time = _points(df, time_field, value_field, row_id).groupBy("ms").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("valued")
    )
    dated = F.col("ms").isNotNull()
    zero = F.lit(0)
    return per_time.agg(
        F.coalesce(F.sum(F.when(dated, F.col("n"))), zero).alias("point_count"),
        F.coalesce(F.sum(F.when(~dated, F.col("n"))), zero).alias("invalid_date_count"),
        F.coalesce(F.sum(F.when(dated, F.col("n") - F.col("valued"))), zero).alias("invalid_value_count"),
        F.coalesce(F.sum(F.when(dated, F.col("n") - 1)), zero).alias("duplicate_count"),
    )


def daily_overview(
    df: DataFrame, *, source: Column, day: Column, order_id: Column, customer: Column,
    sales: Column, quantity: Column,
) -> DataFrame:
    """Totals per (source, day): sales, distinct orders and customers, quantity, mean order value.

    Distinct counts first merge (source, day, order) and (source, day, customer)
    pairs on the map side, so a busy source does not land in one task.
    """
    lines = df.select(
        source.alias("source_system"), day.cast("date").alias("dt"), order_id.alias("order_id"),
        customer.alias("customer"), sales.cast("double").alias("sales"),
        quantity.cast("double").alias("quantity"),
    )
    got = lines.groupBy("source_system", "dt").agg(
        F.sum("sales").alias("total_sales"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer").alias("total_customers"),
        F.sum("quantity").alias("total_quantity"),
    )
    return got.withColumn("avg_order_value", F.try_divide("total_sales", "total_orders"))


def day_state(
    df: DataFrame, *, source: Column, day: Column, order_id: Column, customer: Column,
    sales: Column, quantity: Column,
) -> DataFrame:
    """Mergeable state per (source, day): sums, and bitmaps of whole-numbered orders and customers.

    ``(source_system, dt, kind, bucket, bits, sales, quantity)``: a row of sums for each day, and a bitmap of 64 numbers (a long) for each
    bucket of orders or customers that the day has, so a state has at most a short row per row of the data, however thinly a
    day's numbers lie.  States of parts of the data are put together by
    :func:`merge_states` and counted for any period by :func:`overview_of_state`; no row is counted anew.
    """
    lines = df.select(
        source.alias("source_system"), day.cast("date").alias("dt"), order_id.cast("bigint").alias("orders"),
        customer.cast("bigint").alias("customers"), sales.cast("double").alias("sales"), quantity.cast("double").alias("quantity"),
    )
    state = lines.groupBy("source_system", "dt").agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity")).select(
        "source_system", "dt", F.lit("sums").alias("kind"), F.lit(0).cast("bigint").alias("bucket"), F.lit(None).cast("bigint").alias("bits"),
        "sales", "quantity",
    )
    for kind in ("orders", "customers"):
        bucket = F.shiftright(kind, 6).alias("bucket")
        held = lines.where(F.col(kind).isNotNull()).groupBy("source_system", "dt", bucket)
        # the low 6 bits of a number are its place in the bitmap, the others its bucket; so below zero, too
        bits = held.agg(F.bit_or(F.expr(f"shiftleft(1L, cast({kind} & 63 AS int))")).alias("bits"))
        state = state.unionByName(bits.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return state


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several; each row of the data must be in one of them only, or its sales count twice."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    keys = ("source_system", "dt", "kind", "bucket")
    # by number: state rows compress so well that partitions put together by their bytes would hold millions of them
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, *keys).groupBy(*keys).agg(
        F.bit_or("bits").alias("bits"), F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity")
    )


def overview_of_state(state: DataFrame, period: Column | None = None, by_source: bool = True) -> DataFrame:
    """The measures of :func:`daily_overview` per period (a column over ``dt``; the day if None), from a state."""
    keys = ["source_system", "period"] if by_source else ["period"]
    placed = state.withColumn("period", F.col("dt") if period is None else period)
    merged = placed.groupBy(*keys, "kind", "bucket").agg(
        F.bit_count(F.bit_or("bits")).alias("n"), F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity")
    )
    got = merged.groupBy(*keys).agg(
        F.sum("sales").alias("total_sales"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"total_{kind}") for kind in ("orders", "customers")],
        F.sum("quantity").alias("total_quantity"),
    )
    return got.withColumn("avg_order_value", F.try_divide("total_sales", "total_orders"))


def compare_previous_day(
    days: DataFrame, measures: Sequence[str] = DAY_MEASURES, source: str = "source_system",
    dt: str = "dt",
) -> DataFrame:
    """Each day beside the previous existing day of its source, with percent changes.

    One row per (source, day) is needed, so the window holds one row per day.
    A change is null when the previous value is 0 or there is no previous day.
    """
    w = W.partitionBy(source).orderBy(dt)
    out = days.withColumn("comparison_date", F.lag(dt).over(w))
    out = out.withColumn("comparison_available", F.col("comparison_date").isNotNull())
    for m in measures:
        out = out.withColumn(f"prev_{m}", F.lag(m).over(w))
    for m in measures:
        prev = F.when(F.col(f"prev_{m}") != 0, F.col(f"prev_{m}"))
        out = out.withColumn(f"{m}_percent", F.try_divide(F.col(m) - prev, prev) * 100.0)
    return out


def change_decomposition(compared: DataFrame, level: Column | None = None) -> DataFrame:
    """Sales change of each day with its loss amount and the change of every driver."""
    loss = F.greatest(F.col("prev_total_sales") - F.col("total_sales"), F.lit(0.0))
    return compared.select(
        "source_system", "dt", F.col("comparison_date").alias("prev_dt"),
        "total_sales", F.col("prev_total_sales").alias("prev_sales"),
        F.col("total_sales_percent").alias("sales_change_pct"),
        F.when(F.col("prev_total_sales").isNotNull(), loss).alias("sales_loss_amount"),
        F.col("total_orders_percent").alias("orders_change_pct"),
        F.col("total_customers_percent").alias("customers_change_pct"),
        F.col("total_quantity_percent").alias("quantity_change_pct"),
        F.col("avg_order_value_percent").alias("aov_change_pct"),
        *([level.alias("anomaly_level")] if level is not None else []),
    )


def anomaly_summary(changes: DataFrame) -> DataFrame:
    """Days per level and the summed loss; a missing loss counts as 0."""
    return changes.agg(
        F.count_if(F.col("anomaly_level") == "HIGH").alias("high_count"),
        F.count_if(F.col("anomaly_level") == "MEDIUM").alias("medium_count"),
        F.coalesce(F.sum(F.coalesce("sales_loss_amount", F.lit(0.0))), F.lit(0.0)).alias("total_loss"),
    )
