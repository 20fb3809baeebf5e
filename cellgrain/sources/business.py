"""Daily business metrics as an all-text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrain.operators.cells import text_of

# Source columns and the headers they get.
HEADERS = (
    ("dt", "日期"),
    ("total_sales", "销售额"),
    ("total_orders", "订单数"),
    ("total_customers", "客户数"),
    ("total_quantity", "销售数量"),
    ("avg_order_value", "平均客单价"),
    ("source_system", "数据来源"),
)
EMPTY_WARNING = "指定日期范围内没有可供分析的零售 BI 数据"


def business_table(days: DataFrame) -> DataFrame:
    """Typed day rows to text columns under their display headers."""
    return days.select(*[text_of(days, name).alias(header) for name, header in HEADERS])


def business_warnings(days: DataFrame) -> DataFrame:
    """One row with a message when there is no day at all, else no row."""
    return days.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(EMPTY_WARNING).alias("warning")
    )
