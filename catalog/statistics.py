"""Descriptive statistics, positions, correlation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DIRTY, ORACLES, dirty_orders, load, query, r, rounded, sql_num, sql_text, sql_unpivot
from cellgrain.functions import labels
from cellgrain.functions.numbers import half_up, is_valid_percentile, normalize_score
from cellgrain.functions.text import WHITESPACE
from cellgrain.operators import correlation, filters, outliers, stats
from cellgrain.operators.correlation import CorrelationOptions
from cellgrain.operators.stats import Metric
from cellgrain.plans import registry
from cellgrain.sources import export

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_U = f"u AS ({sql_unpivot('lineitem', MEASURES)})"


@query("min_max", "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def min_max(spark, sf):
    return stats.min_max(load(spark, sf, "orders"), "o_totalprice")


@query("stable_moments", f"""
WITH {_U} SELECT field, count(value) AS valid_count, {r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS std FROM u GROUP BY field""")
def stable_moments(spark, sf):
    return rounded(stats.stable_moments(load(spark, sf, "lineitem"), MEASURES), "mean", "std")


@query("numeric_summary", f"""
WITH {_U}, q AS (SELECT field, count(*) AS count, count(value) AS valid_count, min(value) AS min, max(value) AS max,
  avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM u GROUP BY field)
SELECT field, count, valid_count, count - valid_count AS missing_count,
 {", ".join(f"{r(c)} AS {c}" for c in ("min", "max", "mean", "median", "std", "q1", "q3"))}, {r("q3 - q1")} AS iqr FROM q""")
def numeric_summary(spark, sf):
    return stats.numeric_summary(load(spark, sf, "lineitem"), MEASURES)


_STATS = ("min", "max", "mean", "median", "q25", "q75", "q90", "q95")


def _sql_stats(source: str, keys: str = "field", digits: int = 4) -> str:
    return f"""SELECT {keys}, count(value) AS valid_count, count(*) - count(value) AS invalid_count,
 min(value) AS min, max(value) AS max, {r("avg(value)", digits)} AS mean,
 {", ".join(f"{r(f'quantile_cont(value, {q})', digits)} AS {n}" for n, q in stats.METRIC_QUANTILES.items())}
 FROM {source} GROUP BY {keys}"""


@query("metric_stats", f"""
WITH {_U}, s AS ({_sql_stats("u")}) SELECT field, valid_count AS count, * EXCLUDE (field) FROM s WHERE valid_count > 0""")
def metric_stats(spark, sf):
    got = stats.metric_stats(load(spark, sf, "lineitem"), MEASURES)
    return rounded(got, "mean", *stats.METRIC_QUANTILES)


@query("metric_stats_dirty", f"""
WITH {DIRTY}, u AS (SELECT 'price_text' AS field, {sql_num("price_text")} AS value FROM d), s AS ({_sql_stats("u")})
SELECT field, valid_count AS count, * EXCLUDE (field) FROM s""")
def metric_stats_dirty(spark, sf):
    got = stats.metric_stats(dirty_orders(spark, sf), ["price_text"])
    return rounded(got, "mean", *stats.METRIC_QUANTILES)


@query("suitable_fields", f"""
WITH {DIRTY}, u AS (SELECT 'price_text' AS field, {sql_num("price_text")} AS value FROM d
  UNION ALL SELECT 'date_text', {sql_num("date_text")} FROM d UNION ALL SELECT 'o_totalprice', o_totalprice FROM d)
SELECT field, count(*) AS rows, count(value) AS valid_count, count(value) >= 5 AS suitable,
 count(value) >= count(*) * 0.5 AS is_numeric FROM u GROUP BY field""")
def suitable_fields(spark, sf):
    return stats.suitable_fields(dirty_orders(spark, sf), ["price_text", "date_text", "o_totalprice"])


_POSITION = """SELECT '{field}' AS field, {x}::DOUBLE AS x, n AS total, h AS higher_count, e AS equal_count,
 l AS lower_count, {ahead} + 1 AS best_rank, {ahead} + e AS worst_rank, {ahead} + 1 AS estimated_rank,
 {pct} AS percentile, e > 0 AS exists_in_data, ({x} < lo OR {x} > hi) AS is_out_of_range,
 CASE WHEN {x} < lo THEN 'below' WHEN {x} > hi THEN 'above' END AS out_of_range_direction
FROM (SELECT count(v) AS n, count(*) FILTER (v > {x}) AS h, count(*) FILTER (v = {x}) AS e,
 count(*) FILTER (v < {x}) AS l, min(v) AS lo, max(v) AS hi FROM (SELECT {field} AS v FROM {table}))"""


def _sql_position(table: str, field: str, x: float, lower: bool = False) -> str:
    share = "(h + e)" if lower else "(l + e)"
    return _POSITION.format(
        field=field, table=table, x=x, ahead="l" if lower else "h", pct=r(f"{share} / n * 100.0")
    )


@query("position_higher", _sql_position("orders", "o_totalprice", 250000))
def position_higher(spark, sf):
    return rounded(stats.position(load(spark, sf, "orders"), "o_totalprice", 250000), "percentile")


@query("position_lower", _sql_position("lineitem", "l_quantity", 25, True))
def position_lower(spark, sf):
    got = stats.position(load(spark, sf, "lineitem"), "l_quantity", 25, "lower-is-better")
    return rounded(got, "percentile")


@query("position_outside", _sql_position("lineitem", "l_quantity", 99))
def position_outside(spark, sf):
    return rounded(stats.position(load(spark, sf, "lineitem"), "l_quantity", 99), "percentile")


@query("positions_of_inputs", f"""
WITH n AS (SELECT count(*) AS n FROM orders),
v AS (SELECT o_totalprice AS v, count(*) AS c FROM orders GROUP BY 1),
x AS (SELECT s_suppkey, s_acctbal * 60 AS x FROM supplier),
a AS (SELECT v AS p, c, 0 AS k FROM v UNION ALL SELECT DISTINCT x, 0, 1 FROM x),
w AS (SELECT p, sum(c) AS e, sum(sum(c)) OVER (ORDER BY p) AS upto FROM a GROUP BY p)
SELECT s_suppkey, {r("x")} AS x, cast(n AS BIGINT) AS total, cast(n - upto AS BIGINT) AS higher_count, cast(e AS BIGINT) AS equal_count,
 cast(upto - e AS BIGINT) AS lower_count, cast(n - upto + 1 AS BIGINT) AS best_rank, cast(n - upto + e AS BIGINT) AS worst_rank,
 {r("upto / n * 100.0")} AS percentile, (upto = 0 OR upto - e = n) AS is_out_of_range
FROM x JOIN w ON x.x = w.p CROSS JOIN n""")
def positions_of_inputs(spark, sf):
    asked = load(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") * 60).alias("x"))
    got = stats.positions(load(spark, sf, "orders"), "o_totalprice", asked)
    return rounded(got, "x", "percentile").select(
        "s_suppkey", "x", "total", "higher_count", "equal_count", "lower_count", "best_rank",
        "worst_rank", "percentile", "is_out_of_range",
    )


@query("percentile_of_value", f"""
SELECT 'o_totalprice' AS field, 123456.0::DOUBLE AS x, {r("count(*) FILTER (o_totalprice >= 123456) / count(*) * 100.0")} AS percentile FROM orders""")
def percentile_of_value(spark, sf):
    return rounded(stats.percentile_of_value(load(spark, sf, "orders"), "o_totalprice", 123456, True), "percentile")


METRICS = (
    Metric("l_quantity", "higher-is-better", "数量"),
    Metric("l_extendedprice", "lower-is-better"),
    Metric("l_discount", "neutral"),
)
INPUTS = {"l_quantity": 30.0, "l_extendedprice": 50000.0, "l_discount": 0.05}


def _sql_batch(digits: int = 4) -> str:
    return f"""{_U}, m AS (SELECT * FROM (VALUES ('l_quantity', '数量', 'higher-is-better', 30.0), ('l_extendedprice', 'l_extendedprice', 'lower-is-better', 50000.0),
  ('l_discount', 'l_discount', 'neutral', NULL)) t(field, display_name, direction, x)),
s AS ({_sql_stats("u JOIN m USING (field)", "field, display_name, direction, x", digits).replace("count(value) AS valid_count", "count(value) AS valid_count, count(*) AS total_rows, count(*) FILTER (value > x) AS h, count(*) FILTER (value = x) AS e, count(*) FILTER (value < x) AS l")})"""


@query("metrics_batch", f"""
WITH {_sql_batch()}
SELECT field AS metric, display_name, direction, total_rows, valid_count, invalid_count, {", ".join(_STATS)},
 x::DOUBLE AS user_value, CASE WHEN x IS NOT NULL THEN h END AS higher_count, CASE WHEN x IS NOT NULL THEN e END AS equal_count,
 CASE WHEN x IS NOT NULL THEN l END AS lower_count,
 CASE WHEN x IS NOT NULL THEN CASE WHEN direction = 'lower-is-better' THEN l ELSE h END + 1 END AS best_rank,
 CASE WHEN x IS NOT NULL THEN CASE WHEN direction = 'lower-is-better' THEN l ELSE h END + e END AS worst_rank, CASE WHEN x IS NOT NULL THEN e > 0 END AS exists_in_data,
 CASE WHEN x IS NOT NULL THEN {r("CASE WHEN direction = 'lower-is-better' THEN h + e ELSE l + e END / valid_count * 100.0")} END AS percentile FROM s""")
def metrics_batch(spark, sf):
    got = stats.compute_metrics(load(spark, sf, "lineitem"), METRICS, INPUTS)
    return rounded(got, "mean", "percentile", *stats.METRIC_QUANTILES).select(
        "metric", "display_name", "direction", "total_rows", "valid_count", "invalid_count", *_STATS,
        "user_value", "higher_count", "equal_count", "lower_count", "best_rank", "worst_rank", "exists_in_data", "percentile",
    )


_PLACED = "direction IN ('higher-is-better', 'lower-is-better')"
_SHEET_ROWS = [
    ("field", 0, "指标字段", "field", "true"),
    *[("stats", i, key, c, "valid_count > 0") for i, (key, c) in enumerate((
        ("有效数值", "valid_count"), ("无效/空值", "invalid_count"), ("总数", "valid_count"), ("均值", sql_text("mean", "double")), ("中位数", sql_text("median", "double")),
        ("最小值", sql_text("min", "double")), ("最大值", sql_text("max", "double")), ("Q25", sql_text("q25", "double")), ("Q75", sql_text("q75", "double")),
        ("Q90", sql_text("q90", "double")), ("Q95", sql_text("q95", "double"))))],
    *[("position", i, key, c, _PLACED) for i, (key, c) in enumerate((
        ("总记录数", "valid_count"), ("高于该值记录数", "h"), ("等于该值记录数", "e"), ("低于该值记录数", "l"), ("相对位置区间起点", "ahead + 1"), ("相对位置区间终点", "ahead + e"),
        ("估算相对位置", "ahead + 1"), ("百分位", sql_text("percentile", "double")), ("该值是否存在于数据中", "CASE WHEN e > 0 THEN '是' ELSE '否' END"),
        ("是否超出数据范围", "CASE WHEN x < min THEN '低于数据范围' WHEN x > max THEN '高于数据范围' ELSE '否' END")))],
    ("interpretation", 0, "指标名", "field", "true"), ("interpretation", 1, "显示名", "display_name", "true"),
    ("interpretation", 2, "方向", "CASE direction WHEN 'higher-is-better' THEN '越高越好' WHEN 'lower-is-better' THEN '越低越好' WHEN 'neutral' THEN '中性（无优劣方向）' ELSE '未指定方向' END", "true"),
    ("interpretation", 3, "总行数", "total_rows", "true"), ("interpretation", 4, "有效值数量", "valid_count", "true"), ("interpretation", 5, "无效值数量", "invalid_count", "true"),
    ("interpretation", 6, "说明", "'当前字段方向未指定，仅展示统计分布，不进行优劣评价。'", f"NOT {_PLACED}"),
]


@query("summary_sheet", f"""
WITH {_sql_batch(6)}, z AS (SELECT *, CASE WHEN direction = 'lower-is-better' THEN l ELSE h END AS ahead, {r("CASE WHEN direction = 'lower-is-better' THEN h + e ELSE l + e END / valid_count * 100.0")} AS percentile FROM s)
""" + " UNION ALL ".join(
    f"SELECT field AS metric, '{section}' AS section, {i} AS ord, '{key}' AS key, cast({value} AS varchar) AS value FROM z WHERE {test}" for section, i, key, value, test in _SHEET_ROWS))
def summary_sheet(spark, sf):
    """Every metric, section and row; numbers are cut to a few decimals before they become text."""
    got = rounded(stats.compute_metrics(load(spark, sf, "lineitem"), METRICS, INPUTS), "percentile")
    return export.summary_sheet(rounded(got, "mean", *stats.METRIC_QUANTILES, digits=6))


query("summary_sheet_whole", ORACLES["summary_sheet"])(summary_sheet)


@query("category_top_n", """
WITH c AS (SELECT field, value, count(*) AS n FROM (SELECT 'p_brand' AS field, p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part) GROUP BY 1, 2),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INT) AS rank FROM c)
SELECT * FROM k WHERE rank <= 5""")
def category_top_n(spark, sf):
    return stats.category_top_n(load(spark, sf, "part"), ["p_brand", "p_type", "p_name"], 5)


@query("top_lines", f"""
WITH l AS (SELECT trim(unnest(string_split(text, chr(10))), '{WHITESPACE}') AS value FROM documents WHERE text IS NOT NULL), c AS (SELECT value, count(*) AS n FROM l WHERE value <> '' GROUP BY 1)
SELECT value, n, cast(row_number() OVER (ORDER BY n DESC, value) AS INT) AS rank FROM c QUALIFY rank <= 10""")
def top_lines(spark, sf):
    """The most frequent lines of all documents."""
    lines = load(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return stats.top_values(lines, "line", 10)


@query("category_counts", "SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY 2")
def category_counts(spark, sf):
    return stats.category_counts(load(spark, sf, "events"), ["event_type"])


@query("time_range", """
SELECT 'ts' AS field, count(*) AS count, count(ts) AS valid_count, count(*) - count(ts) AS missing_count,
 epoch_us(min(ts)) // 1000 AS min_ms, epoch_us(max(ts)) // 1000 AS max_ms, strftime(min(ts), '%Y-%m-%d') AS min_date,
 strftime(max(ts), '%Y-%m-%d') AS max_date FROM events""")
def time_range(spark, sf):
    return stats.time_range(load(spark, sf, "events"), "ts")


@query("boxplot", f"""
SELECT 'value' AS field, min(value) AS min, {r("quantile_cont(value, 0.25)")} AS q25, {r("quantile_cont(value, 0.5)")} AS median,
 {r("quantile_cont(value, 0.75)")} AS q75, max(value) AS max, CASE WHEN 60 >= quantile_cont(value, 0.75) THEN 'upper'
 WHEN 60 >= quantile_cont(value, 0.5) THEN 'upper_middle' WHEN 60 >= quantile_cont(value, 0.25) THEN 'lower_middle' ELSE 'lower' END AS zone FROM events""")
def boxplot(spark, sf):
    return rounded(stats.five_numbers(load(spark, sf, "events"), "value", 60), "q25", "median", "q75")


@query("tier_labels", f"""
WITH p AS (SELECT o_orderkey, {r("cume_dist() OVER (ORDER BY o_totalprice) * 100")} AS p FROM orders)
SELECT CASE WHEN p >= 90 THEN 'top10' WHEN p >= 75 THEN 'top25' WHEN p >= 25 THEN 'middle' WHEN p >= 10 THEN 'bottom25' ELSE 'bottom10' END AS tier,
 count(*) AS records, count(*) FILTER (p BETWEEN 0 AND 100) AS valid FROM p GROUP BY 1""")
def tier_labels(spark, sf):
    from cellgrain.operators.distribution import ranked_records

    p = F.col("percentile")
    return ranked_records(load(spark, sf, "orders"), "o_totalprice").groupBy(labels.tier(p).alias("tier")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(is_valid_percentile(p)).alias("valid")
    )


@query("normalized_scores", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE {r("o_totalprice / 500000.0 * 100.0")} END AS normalized FROM orders""")
def normalized_scores(spark, sf):
    full = F.when(F.col("o_orderkey") % 9 == 0, F.lit(0.0)).otherwise(F.lit(500000.0))
    n = half_up(normalize_score(F.col("o_totalprice"), full), 4).alias("normalized")
    return load(spark, sf, "orders").select("o_orderkey", n)


# ---- correlation ---------------------------------------------------------------------
def _pair(i: int, j: int, a: str, b: str) -> str:
    ok = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    rr = f"coalesce(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) {ok}) * sqrt(var_pop({b}) {ok}), 0), 0)"
    return (
        f"SELECT {i} AS i, {j} AS j, '{a}' AS field_a, '{b}' AS field_b, count(*) {ok} AS valid_count, "
        f"CASE WHEN count(*) {ok} < 2 THEN 0.0 ELSE greatest(-1.0, least(1.0, {rr})) END AS r FROM c"
    )


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_per_unit", "fixed"]
_PAIRS = """c AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS l_tax,
 l_extendedprice / l_quantity AS price_per_unit, 7.0 AS fixed FROM lineitem), p AS (""" + " UNION ALL ".join(
    _pair(i, j, CORR[i], CORR[j]) for i in range(len(CORR)) for j in range(i + 1, len(CORR))
) + f"), k AS (SELECT *, {r('r')} AS pearson, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r > 0.01 THEN 'positive' WHEN r < -0.01 THEN 'negative' ELSE 'none' END AS direction FROM p)"


def _corr_frame(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("l_tax"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_unit"),
        F.lit(7.0).alias("fixed"),
    )


@query("correlation_pairs", f"WITH {_PAIRS} SELECT field_a, field_b, valid_count, pearson, strength, direction FROM k")
def correlation_pairs(spark, sf):
    return correlation.correlation_pairs(_corr_frame(spark, sf), CORR).select(
        "field_a", "field_b", "valid_count", "pearson", "strength", "direction"
    )


@query("correlation_matrix", f"""WITH {_PAIRS} SELECT field_a, field_b, pearson FROM k UNION ALL SELECT field_b, field_a, pearson FROM k
 UNION ALL SELECT unnest({CORR!r}), unnest({CORR!r}), 1.0""")
def correlation_matrix(spark, sf):
    pairs = correlation.correlation_pairs(_corr_frame(spark, sf), CORR)
    return correlation.correlation_matrix(pairs, CORR)


@query("correlation_top_pairs", f"""WITH {_PAIRS}, t AS (
 SELECT 'positive' AS kind, row_number() OVER (ORDER BY pearson DESC, i, j) AS rank, * FROM k WHERE pearson > 0 AND valid_count >= 5
 UNION ALL SELECT 'negative', row_number() OVER (ORDER BY pearson, i, j), * FROM k WHERE pearson < 0 AND valid_count >= 5
 UNION ALL SELECT 'weak', row_number() OVER (ORDER BY abs(pearson), i, j), * FROM k WHERE strength = 'weak' AND valid_count >= 5)
SELECT kind, cast(rank AS INT) AS rank, field_a, field_b, pearson, valid_count, strength, direction FROM t WHERE rank <= 3""")
def correlation_top_pairs(spark, sf):
    options = CorrelationOptions(top_n=3)
    return correlation.top_pairs(correlation.correlation_pairs(_corr_frame(spark, sf), CORR, options), options)


@query("correlation_candidates", """
WITH u AS (SELECT 0 AS ordinal, 'o_orderkey' AS field, cast(o_orderkey AS DOUBLE) AS v FROM orders UNION ALL SELECT 1, 'o_custkey', o_custkey FROM orders
 UNION ALL SELECT 2, 'o_totalprice', o_totalprice FROM orders UNION ALL SELECT 3, 'fixed', 3 FROM orders UNION ALL SELECT 4, 'order_id', o_custkey FROM orders),
s AS (SELECT ordinal, field, count(v) AS valid_count, count(DISTINCT v) AS unique_count, max(v) AS max FROM u GROUP BY 1, 2)
SELECT ordinal::INT AS ordinal, field, valid_count, unique_count, max, CASE WHEN field <> 'o_totalprice' AND (contains(field, 'id') OR (valid_count >= 10 AND unique_count > 0.95 * valid_count AND max > 10000)) THEN 'high-unique-id'
 WHEN unique_count <= 1 THEN 'constant' ELSE 'keep' END AS status FROM s""")
def correlation_candidates(spark, sf):
    df = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.lit(3).alias("fixed"), F.col("o_custkey").alias("order_id")
    )
    return correlation.correlation_candidates(df, df.columns, {"o_totalprice": "metric"})


@query("correlation_auto", f"""WITH c AS (SELECT l_quantity, l_discount, l_tax FROM lineitem), p AS (
 {_pair(0, 1, "l_quantity", "l_discount")} UNION ALL {_pair(0, 2, "l_quantity", "l_tax")} UNION ALL {_pair(1, 2, "l_discount", "l_tax")})
SELECT field_a, field_b, valid_count, {r("r")} AS pearson FROM p""")
def correlation_auto(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", F.lit(1).alias("one"))
    return correlation.correlate_auto(df).select("field_a", "field_b", "valid_count", "pearson")


# ---- outliers ------------------------------------------------------------------------
# value: skewed; flat: one main value with rare large ones; code: small ordinals;
# main: flat quartiles with some variation around them; tiny: a few numbers only
OUTLIER_FIELDS = ["value", "flat", "code", "main", "steady", "tiny"]


def _spiky(spark, sf):
    k = F.col("event_id")
    return load(spark, sf, "events").select(
        k.alias("_row_id"), "value",
        F.when(k % 97 == 0, F.lit(1000.0)).when(k % 101 == 0, F.lit(-999.0)).otherwise(F.lit(10.0)).alias("flat"),
        (k % 5).cast("double").alias("code"),
        F.when(k % 10 == 0, F.lit(11.0)).otherwise(F.lit(10.0)).alias("main"),
        F.lit(4.0).alias("steady"),
        F.when(k < 5, k.cast("double")).alias("tiny"),
    )


_SPIKY = """e AS (SELECT event_id AS _row_id, value, CASE WHEN event_id % 97 = 0 THEN 1000.0 WHEN event_id % 101 = 0 THEN -999.0 ELSE 10.0 END::DOUBLE AS flat,
 (event_id % 5)::DOUBLE AS code, CASE WHEN event_id % 10 = 0 THEN 11.0 ELSE 10.0 END::DOUBLE AS main, 4.0::DOUBLE AS steady,
 CASE WHEN event_id < 5 THEN event_id END::DOUBLE AS tiny FROM events),
u AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS field, _row_id, {f} AS v FROM e" for f in OUTLIER_FIELDS) + """),
q AS (SELECT field, count(v) AS sample_size, count(DISTINCT v) AS unique_count, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
 quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, bool_and(floor(v) = v) AS whole, avg(v) AS mean, stddev_pop(v) AS std FROM u GROUP BY field),
m AS (SELECT field, quantile_cont(abs(v - med), 0.5) AS mad FROM u JOIN q USING (field) WHERE v IS NOT NULL GROUP BY field),
b AS (SELECT q.*, mad, CASE WHEN sample_size < 8 THEN 'insufficient_data' WHEN q3 = q1 AND hi = lo THEN 'none'
  WHEN q3 > q1 AND whole AND unique_count <= 6 AND hi <= 20 THEN 'unsupported' END AS idle FROM q JOIN m USING (field)),
h AS (SELECT u.field, _row_id, v, b.* EXCLUDE (field), CASE WHEN q3 > q1 THEN v > q3 + 1.5 * (q3 - q1) ELSE v > med END AS high FROM u JOIN b USING (field)
 WHERE idle IS NULL AND v IS NOT NULL AND CASE WHEN q3 > q1 THEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)
  WHEN mad > 0 THEN abs(0.6745 * (v - med) / mad) > 3.5 ELSE abs(v - med) > 3 * greatest(abs(med), 1) END),
n AS (SELECT field, count(*) AS c, count(*) FILTER (high) AS up FROM h GROUP BY field)"""


@query("outlier_status", f"""WITH {_SPIKY} SELECT b.field, coalesce(idle, CASE WHEN coalesce(c, 0) > 0 THEN 'detected' WHEN q3 > q1 THEN 'none' ELSE 'insufficient_variation' END) AS status,
 sample_size, unique_count, coalesce(idle = 'unsupported', false) AS discrete_low_cardinality, coalesce(c, 0) AS outlier_count, coalesce(up, 0) AS high_count, coalesce(c - up, 0) AS low_count,
 {r("CASE WHEN sample_size >= 8 AND idle IS DISTINCT FROM 'unsupported' THEN q1 - 1.5 * (q3 - q1) END")} AS lower, {r("CASE WHEN sample_size >= 8 AND idle IS DISTINCT FROM 'unsupported' THEN q3 + 1.5 * (q3 - q1) END")} AS upper
FROM b LEFT JOIN n ON n.field = b.field""")
def outlier_status(spark, sf):
    got = outliers.outlier_status(_spiky(spark, sf), OUTLIER_FIELDS)
    return rounded(got, "lower", "upper").select(
        "field", "status", "sample_size", "unique_count", "discrete_low_cardinality", "outlier_count",
        "high_count", "low_count", "lower", "upper",
    )


@query("outlier_records", f"""WITH {_SPIKY} SELECT _row_id, field, v AS value, CASE WHEN high THEN 'high' ELSE 'low' END AS direction,
 {r("CASE WHEN q3 > q1 THEN CASE WHEN high THEN v - (q3 + 1.5 * (q3 - q1)) ELSE (q1 - 1.5 * (q3 - q1)) - v END ELSE abs(v - med) END")} AS distance,
 CASE WHEN q3 > q1 THEN CASE WHEN high THEN 'above_upper_fence' ELSE 'below_lower_fence' END WHEN mad > 0 THEN 'median_deviation' ELSE 'far_from_main_value' END AS reason,
 CASE WHEN high AND q3 + 1.5 * (q3 - q1) > 0 THEN {r("CASE WHEN q3 > q1 THEN v - (q3 + 1.5 * (q3 - q1)) ELSE abs(v - med) END / (q3 + 1.5 * (q3 - q1)) * 100.0")} END AS overrun_percent,
 {r("CASE WHEN q3 = q1 AND mad > 0 THEN 0.6745 * (v - med) / mad END")} AS modified_z FROM h""")
def outlier_records(spark, sf):
    df = _spiky(spark, sf)
    bounds = outliers.outlier_bounds(df, OUTLIER_FIELDS, unique=False)
    return rounded(outliers.outlier_records(df, bounds, OUTLIER_FIELDS), "distance", "overrun_percent", "modified_z")


@query("outliers_mad", f"""
WITH e AS (SELECT o_orderkey AS _row_id, CASE WHEN o_orderkey % 20 < 11 THEN 50.0 WHEN o_orderkey % 20 = 19 THEN o_totalprice ELSE 50.0 + o_orderkey % 20 END::DOUBLE AS v FROM orders),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM e),
m AS (SELECT quantile_cont(abs(v - med), 0.5) AS mad FROM e, q)
SELECT q3 - q1 AS iqr, mad, count(*) AS outlier_count FROM e, q, m WHERE CASE WHEN q3 > q1 THEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)
 WHEN mad > 0 THEN abs(0.6745 * (v - med) / mad) > 3.5 ELSE abs(v - med) > 3 * greatest(abs(med), 1) END GROUP BY ALL""".replace("mad, count", "coalesce(CASE WHEN q3 = q1 THEN mad END, 0.0) AS mad, count"))
def outliers_mad(spark, sf):
    k = F.col("o_orderkey") % 20
    df = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("_row_id"),
        F.when(k < 11, F.lit(50.0)).when(k == 19, F.col("o_totalprice")).otherwise(k + 50.0).alias("v"),
    )
    bounds = outliers.outlier_bounds(df, ["v"], unique=False)
    counted = outliers.outlier_status(df, ["v"], bounds=bounds)
    return counted.join(bounds.select("field", F.coalesce("mad", F.lit(0.0)).alias("mad")), "field").select(
        "iqr", "mad", "outlier_count"
    )


@query("median_deviations", f"""WITH {_U}, q AS (SELECT field, count(value) AS valid_count, quantile_cont(value, 0.5) AS median FROM u GROUP BY field)
SELECT field, valid_count, {r("median")} AS median, {r("quantile_cont(abs(value - median), 0.5)")} AS mad FROM u JOIN q USING (field) GROUP BY field, valid_count, median""")
def median_deviations(spark, sf):
    return rounded(outliers.median_deviations(load(spark, sf, "lineitem"), MEASURES), "median", "mad")


@query("outlier_roles", f"""
WITH s AS (SELECT count(DISTINCT o_totalprice) AS u, count(*) AS n FROM orders) SELECT 'o_totalprice' AS field, 'unsupported' AS status, n AS sample_size, u AS unique_count, 0::BIGINT AS outlier_count FROM s""")
def outlier_roles(spark, sf):
    got = outliers.outlier_status(load(spark, sf, "orders"), ["o_totalprice"], {"o_totalprice": "identifier"})
    return got.select("field", "status", "sample_size", "unique_count", "outlier_count")


@query("outlier_explain", f"""WITH {_SPIKY} SELECT b.field, coalesce(up, 0) AS high_count, coalesce(c - up, 0) AS low_count, coalesce(c, 0) AS total_outliers,
 concat('共有 ', coalesce(c, 0), ' 条记录超出该范围', CASE WHEN coalesce(c, 0) > 0 THEN '：' ELSE '' END,
  CASE WHEN up > 0 THEN concat(up, ' 条高于上界') ELSE '' END, CASE WHEN up > 0 AND c > up THEN '，' ELSE '' END, CASE WHEN c > up THEN concat(c - up, ' 条低于下界') ELSE '' END) AS counts_line
FROM b LEFT JOIN n ON n.field = b.field""")
def outlier_explain(spark, sf):
    return outliers.outlier_explanation(outliers.outlier_status(_spiky(spark, sf), OUTLIER_FIELDS)).select(
        "field", "high_count", "low_count", "total_outliers", "counts_line"
    )


@query("outliers_scored", f"""WITH {_SPIKY}, z AS (SELECT *, {r("CASE WHEN std = 0 THEN 0 ELSE (v - mean) / std END")} AS z FROM h)
SELECT _row_id, field, v AS value, {r("z", 3)} AS z_score, CASE WHEN v <= -900 THEN 'auto-exclude' WHEN z > 3 THEN 'mark' ELSE 'keep' END AS strategy,
 CASE WHEN v > 0 THEN 'extremeHigh' ELSE 'extremeLow' END AS outlier_class FROM z""")
def outliers_scored(spark, sf):
    got = outliers.scored_outliers(_spiky(spark, sf), OUTLIER_FIELDS)
    return rounded(got, "z_score", digits=3).select("_row_id", "field", "value", "z_score", "strategy", "outlier_class")


@query("outliers_iqr", f"""
WITH q AS (SELECT {r("quantile_cont(value, 0.25)")} AS q1, {r("quantile_cont(value, 0.75)")} AS q3, {r("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")} AS iqr, {r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS std FROM events)
SELECT event_id AS _row_id, 'value' AS field, value, {r(r("(value - mean) / std"), 3)} AS z_score FROM events, q WHERE value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr""")
def outliers_iqr(spark, sf):
    got = outliers.plain_outliers(_spiky(spark, sf), ["value"])
    return rounded(got, "z_score", digits=3)


@query("exclude_outliers", f"""WITH {_SPIKY} SELECT count(*) AS rows, sum(flat) AS total FROM e WHERE _row_id NOT IN (SELECT _row_id FROM h WHERE field = 'flat' AND v <= -900) AND _row_id % 500 <> 7""")
def exclude_outliers(spark, sf):
    df = _spiky(spark, sf)
    manual = df.where(F.col("_row_id") % 500 == 7).select("_row_id")
    kept = filters.exclude_rows(df, outliers.excluded_ids(df, "flat", manual=manual))
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("flat").alias("total"))


@query("mean_change", f"""WITH {_SPIKY}, k AS (SELECT v, _row_id IN (SELECT _row_id FROM h WHERE field = 'value') AS gone FROM u WHERE field = 'value'),
s AS (SELECT count(v) AS total, count(v) FILTER (NOT gone) AS remaining, avg(v) AS old_mean, avg(v) FILTER (NOT gone) AS new_mean FROM k)
SELECT 'value' AS field, total, remaining, {r("old_mean")} AS old_mean, {r("new_mean")} AS new_mean, {r("new_mean - old_mean")} AS change,
 {r("(new_mean - old_mean) / abs(old_mean) * 100.0")} AS change_percent, CASE WHEN total = remaining THEN 'unchanged' ELSE 'changed' END AS outcome FROM s""")
def mean_change(spark, sf):
    df = _spiky(spark, sf)
    found = outliers.outlier_records(df, outliers.outlier_bounds(df, ["value"]), ["value"])
    return rounded(outliers.mean_change(df, "value", found), "old_mean", "new_mean", "change", "change_percent")


@query("registered_metric", f"""
SELECT 'o_totalprice' AS metric, count(*) FILTER (o_totalprice >= 250000) AS passed, {r("count(*) FILTER (o_totalprice >= 250000) / count(*)")} AS pass_rate FROM orders""")
def registered_metric(spark, sf):
    from cellgrain.operators.cells import number_of

    def pass_rate(df, metric, user_value):
        v = number_of(df, metric.name)
        return df.agg(
            F.count_if(v >= user_value).alias("passed"), F.try_divide(F.count_if(v >= user_value), F.count(v)).alias("pass_rate")
        ).select(F.lit(metric.name).alias("metric"), "passed", half_up(F.col("pass_rate"), 4).alias("pass_rate"))

    book = registry.MetricRegistry()
    book.register(registry.MetricDef("o_totalprice", pass_rate, "pass rate"))
    return book.compute(load(spark, sf, "orders"), Metric("o_totalprice"), 250000.0)
