"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DIRTY, dirty_orders, load, query, r, rounded, sql_num
from cellgrain.operators import groups
from cellgrain.sources import export


def _sql_groups(source: str, key: str, value: str, having: str = "") -> str:
    return f"""SELECT {key} AS dimension_value, count({value}) AS count, {r(f"avg({value})")} AS mean,
 {r(f"quantile_cont({value}, 0.5)")} AS median, min({value}) AS min, max({value}) AS max,
 {r(f"quantile_cont({value}, 0.25)")} AS q25, {r(f"quantile_cont({value}, 0.75)")} AS q75 FROM {source} GROUP BY 1 {having}"""


def _cut(df):
    return rounded(df, "mean", "median", "q25", "q75")


@query("group_by_dimension", _sql_groups("lineitem", "l_returnflag", "l_extendedprice"))
def group_by_dimension(spark, sf):
    return _cut(groups.group_by_dimension(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("group_by_many_keys", _sql_groups("lineitem", "cast(l_partkey AS varchar)", "l_quantity"))
def group_by_many_keys(spark, sf):
    return _cut(groups.group_by_dimension(load(spark, sf, "lineitem"), "l_quantity", "l_partkey", ordered=False))


_DIM = "CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 5 = 1 THEN '-' ELSE concat(' ', o_orderpriority, ' ') END"


@query("group_dirty", f"WITH {DIRTY}, g AS (SELECT CASE WHEN trim({_DIM}) = '' THEN '(空值)' ELSE trim({_DIM}) END AS k, {sql_num('price_text')} AS v FROM d) "
       + _sql_groups("g", "k", "v", "HAVING count(v) > 0"))
def group_dirty(spark, sf):
    df = dirty_orders(spark, sf).withColumn("k", F.expr(_DIM))
    return _cut(groups.group_by_dimension(df, "price_text", "k"))


@query("group_top_n", _sql_groups("orders", "cast(o_custkey AS varchar)", "o_totalprice") + " ORDER BY max DESC, dimension_value LIMIT 20")
def group_top_n(spark, sf):
    got = groups.group_by_dimension(load(spark, sf, "orders"), "o_totalprice", "o_custkey", ordered=False)
    return _cut(groups.top_groups(got, by="max"))


@query("group_sorted", _sql_groups("part", "p_brand", "p_retailprice"))
def group_sorted(spark, sf):
    return _cut(groups.sort_groups(groups.group_by_dimension(load(spark, sf, "part"), "p_retailprice", "p_brand", ordered=False), "count", True))


@query("group_sheet", f"""WITH g AS ({_sql_groups("lineitem", "l_linestatus", "l_quantity")}) SELECT dimension_value AS 维度值, count AS 数量, mean AS 均值,
 median AS 中位数, min AS 最小值, max AS 最大值, q25 AS "Q25", q75 AS "Q75" FROM g""")
def group_sheet(spark, sf):
    return export.group_sheet(_cut(groups.group_by_dimension(load(spark, sf, "lineitem"), "l_quantity", "l_linestatus")))
