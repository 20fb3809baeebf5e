"""Time series, daily totals and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DIRTY, dirty_orders, load, query, r, rounded, sql_date_ms, sql_num
from cellgrain.operators import timeseries
from cellgrain.sources import business


@query("time_series", "SELECT event_id AS _row_id, epoch_us(ts) // 1000 AS ms, value FROM events")
def time_series(spark, sf):
    df = load(spark, sf, "events").withColumnRenamed("event_id", "_row_id")
    return timeseries.time_series(df, "ts", "value").drop("date_label")


@query("time_series_dirty", f"""WITH {DIRTY} SELECT o_orderkey AS _row_id, {sql_date_ms("date_text")} AS ms, trim(date_text) AS date_label, {sql_num("price_text")} AS value
FROM d WHERE {sql_date_ms("date_text")} IS NOT NULL""")
def time_series_dirty(spark, sf):
    df = dirty_orders(spark, sf).withColumnRenamed("o_orderkey", "_row_id")
    return timeseries.time_series(df, "date_text", "price_text")


@query("time_series_quality", f"""WITH {DIRTY}, p AS (SELECT {sql_date_ms("date_text")} AS ms, {sql_num("price_text")} AS v FROM d)
SELECT count(ms) AS point_count, count(*) - count(ms) AS invalid_date_count, count(*) FILTER (ms IS NOT NULL AND v IS NULL) AS invalid_value_count,
 count(ms) - count(DISTINCT ms) AS duplicate_count FROM p""")
def time_series_quality(spark, sf):
    df = dirty_orders(spark, sf).withColumnRenamed("o_orderkey", "_row_id")
    return timeseries.time_series_quality(df, "date_text", "price_text")


def _days(spark, sf):
    """Daily totals of orders per status; quantities are those of the order's line items."""
    c = F.col
    quantity = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    df = load(spark, sf, "orders").join(quantity, c("o_orderkey") == c("l_orderkey"), "left")
    return timeseries.daily_overview(
        df, source=c("o_orderstatus"), day=c("o_orderdate"), order_id=c("o_orderkey"), customer=c("o_custkey"),
        sales=c("o_totalprice"), quantity=F.coalesce(c("quantity"), F.lit(0.0)),
    )


_DAYS = """i AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
t AS (SELECT o_orderstatus AS source_system, cast(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS total_sales, count(DISTINCT o_orderkey) AS total_orders,
 count(DISTINCT o_custkey) AS total_customers, sum(coalesce(quantity, 0.0))::DOUBLE AS total_quantity, sum(o_totalprice) / count(DISTINCT o_orderkey) AS avg_order_value
 FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def _pct(m: str) -> str:
    return f"({m} - nullif(prev_{m}, 0)) / nullif(prev_{m}, 0) * 100.0"


_COMPARED = _DAYS + """, c AS (SELECT *, lag(dt) OVER w AS comparison_date, """ + ", ".join(
    f"lag({m}) OVER w AS prev_{m}" for m in timeseries.DAY_MEASURES
) + " FROM t WINDOW w AS (PARTITION BY source_system ORDER BY dt))"


@query("daily_overview", f"WITH {_DAYS} SELECT source_system, cast(dt AS varchar) AS dt, {r('total_sales', 3)} AS total_sales, total_orders, total_customers, total_quantity, {r('avg_order_value', 6)} AS avg_order_value FROM t")
def daily_overview(spark, sf):
    got = _days(spark, sf).withColumn("dt", F.col("dt").cast("string"))
    return rounded(rounded(got, "total_sales", digits=3), "avg_order_value", digits=6)


@query("prev_day_comparison", f"WITH {_COMPARED} SELECT source_system, cast(dt AS varchar) AS dt, cast(comparison_date AS varchar) AS comparison_date, comparison_date IS NOT NULL AS comparison_available, "
       + ", ".join(f"{r(_pct(m), 3)} AS {m}_percent" for m in timeseries.DAY_MEASURES) + " FROM c")
def prev_day_comparison(spark, sf):
    got = timeseries.compare_previous_day(_days(spark, sf))
    percents = [f"{m}_percent" for m in timeseries.DAY_MEASURES]
    return rounded(got, *percents, digits=3).select(
        "source_system", F.col("dt").cast("string").alias("dt"),
        F.col("comparison_date").cast("string").alias("comparison_date"), "comparison_available", *percents,
    )


_LOSS = "CASE WHEN prev_total_sales IS NOT NULL THEN greatest(prev_total_sales - total_sales, 0.0) END"


@query("change_decomposition", f"""WITH {_COMPARED} SELECT source_system, cast(dt AS varchar) AS dt, cast(comparison_date AS varchar) AS prev_dt, {r("total_sales", 3)} AS total_sales,
 {r("prev_total_sales", 3)} AS prev_sales, {r(_pct("total_sales"), 3)} AS sales_change_pct, {r(_LOSS, 3)} AS sales_loss_amount, {r(_pct("total_orders"), 3)} AS orders_change_pct,
 {r(_pct("total_customers"), 3)} AS customers_change_pct, {r(_pct("total_quantity"), 3)} AS quantity_change_pct, {r(_pct("avg_order_value"), 3)} AS aov_change_pct FROM c""")
def change_decomposition(spark, sf):
    got = timeseries.change_decomposition(timeseries.compare_previous_day(_days(spark, sf)))
    return rounded(
        got, "total_sales", "prev_sales", "sales_change_pct", "sales_loss_amount", "orders_change_pct",
        "customers_change_pct", "quantity_change_pct", "aov_change_pct", digits=3,
    ).withColumns({d: F.col(d).cast("string") for d in ("dt", "prev_dt")})


@query("anomaly_summary", f"""WITH {_COMPARED} SELECT count(*) FILTER ({_pct("total_sales")} <= -80) AS high_count,
 count(*) FILTER ({_pct("total_sales")} > -80 AND {_pct("total_sales")} <= -50) AS medium_count, {r(f"sum(coalesce({_LOSS}, 0))", 2)} AS total_loss FROM c""")
def anomaly_summary(spark, sf):
    compared = timeseries.compare_previous_day(_days(spark, sf))
    p = F.col("total_sales_percent")
    level = F.when(p <= -80, "HIGH").when(p <= -50, "MEDIUM")
    got = timeseries.anomaly_summary(timeseries.change_decomposition(compared, level))
    return rounded(got, "total_loss", digits=2)


@query("business_table", f"""WITH {_DAYS} SELECT cast(dt AS varchar) AS 日期, cast(cast(floor(total_sales) AS BIGINT) AS varchar) AS 销售额, cast(total_orders AS varchar) AS 订单数,
 cast(total_customers AS varchar) AS 客户数, cast(cast(total_quantity AS BIGINT) AS varchar) AS 销售数量, cast(cast(floor(avg_order_value) AS BIGINT) AS varchar) AS 平均客单价, source_system AS 数据来源 FROM t""")
def business_table(spark, sf):
    whole = {m: F.floor(m).cast("double") for m in ("total_sales", "avg_order_value")}
    return business.business_table(_days(spark, sf).withColumns(whole))


def _level(name: str, period: str, source: str) -> str:
    return f"""SELECT '{name}' AS level, {source} AS source_system, {period} AS period, {r("sum(o_totalprice)", 2)} AS total_sales, count(DISTINCT o_orderkey) AS total_orders,
 count(DISTINCT o_custkey) AS total_customers, sum(coalesce(quantity, 0.0))::DOUBLE AS total_quantity FROM o GROUP BY ALL"""


@query("state_overview", "WITH i AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), o AS (SELECT * FROM orders LEFT JOIN i ON o_orderkey = l_orderkey) "
       + " UNION ALL ".join(_level(*x) for x in (
           ("day", "strftime(o_orderdate, '%Y-%m-%d')", "o_orderstatus"), ("month", "strftime(o_orderdate, '%Y-%m')", "o_orderstatus"), ("all", "'all'", "NULL"))))
def state_overview(spark, sf):
    """Days, months and the whole, from a state that was built of three parts of the orders."""
    c = F.col
    quantity = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    df = load(spark, sf, "orders").join(quantity, c("o_orderkey") == c("l_orderkey"), "left")
    state = timeseries.merge_states(*[
        timeseries.day_state(
            df.where(c("o_orderkey") % 3 == k), source=c("o_orderstatus"), day=c("o_orderdate"), order_id=c("o_orderkey"), customer=c("o_custkey"),
            sales=c("o_totalprice"), quantity=F.coalesce(c("quantity"), F.lit(0.0)),
        ) for k in range(3)
    ])
    day, month = F.date_format("dt", "yyyy-MM-dd"), F.date_format("dt", "yyyy-MM")
    out = None
    for level, period, by_source in (("day", day, True), ("month", month, True), ("all", F.lit("all"), False)):
        part = timeseries.overview_of_state(state, period, by_source).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return rounded(out, "total_sales", digits=2).select(
        "level", "source_system", "period", "total_sales", "total_orders", "total_customers", "total_quantity"
    )
