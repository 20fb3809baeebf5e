"""Histogram, quartile segments, distribution, ranks, samples and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import load, query, r, rounded, scratch, sql_unpivot
from cellgrain.functions.numbers import half_up
from cellgrain.operators import distribution, ordering, sampling
from cellgrain.operators.sampling import SizeGate
from cellgrain.plans import explain
from cellgrain.sources import pages

_HIST = """m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 12.0 AS w FROM orders),
b AS (SELECT least(cast(floor((o_totalprice - lo) / w) AS INT), 11) AS bin, count(*) AS c FROM orders, m GROUP BY 1),
h AS (SELECT cast(g.bin AS INT) AS bin, lo + g.bin * w AS start, lo + g.bin * w + w AS "end", coalesce(c, 0) AS count FROM range(12) g(bin) CROSS JOIN m LEFT JOIN b ON b.bin = g.bin)"""


@query("histogram", f"""WITH {_HIST} SELECT bin, {r("start")} AS start, {r('"end"')} AS "end", count,
 concat(cast(floor(start + 0.5) AS BIGINT), '~', cast(floor("end" + 0.5) AS BIGINT)) AS label FROM h""")
def histogram(spark, sf):
    return rounded(distribution.histogram(load(spark, sf, "orders"), "o_totalprice", 12), "start", "end")


@query("histogram_with_gaps", """
WITH m AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT value * value AS v FROM events)),
b AS (SELECT least(cast(floor((value * value - lo) / ((hi - lo) / 20.0)) AS INT), 19) AS bin, count(*) AS c FROM events, m GROUP BY 1)
SELECT cast(g.bin AS INT) AS bin, coalesce(c, 0) AS count FROM range(20) g(bin) LEFT JOIN b ON b.bin = g.bin""")
def histogram_with_gaps(spark, sf):
    squares = load(spark, sf, "events").select((F.col("value") * F.col("value")).alias("v"))
    return distribution.histogram(squares, "v", 20).select("bin", "count")


@query("histogram_locate", f"""WITH {_HIST} SELECT 250000.0::DOUBLE AS x, max(bin) FILTER (start <= 250000 AND 250000 < "end") AS bin,
 min(start) > 250000 AS below_range, max("end") < 250000 AS above_range FROM h""")
def histogram_locate(spark, sf):
    return distribution.locate_bin(distribution.histogram(load(spark, sf, "orders"), "o_totalprice", 12), 250000)


@query("quartile_segments", f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c, count(*) AS n FROM orders),
s AS (SELECT CASE WHEN o_totalprice < a THEN 1 WHEN o_totalprice < b THEN 2 WHEN o_totalprice < c THEN 3 ELSE 4 END AS segment, count(*) AS k FROM orders, q GROUP BY 1)
SELECT segment, CASE segment WHEN 1 THEN '低于 Q1' WHEN 2 THEN 'Q1 至中位数' WHEN 3 THEN '中位数至 Q3' ELSE 'Q3 及以上' END AS name, k AS count,
 {r("k / n * 100.0")} AS percentage, {r("a")} AS q1, {r("b")} AS median, {r("c")} AS q3, false AS all_same FROM s, q""")
def quartile_segments(spark, sf):
    got = distribution.quartile_segments(load(spark, sf, "orders"), "o_totalprice")
    return rounded(got, "percentage", "q1", "median", "q3")


@query("quartile_segments_constant", """
SELECT 0 AS segment, '全部数据相同' AS name, count(*) AS count, true AS all_same FROM orders""")
def quartile_segments_constant(spark, sf):
    one = load(spark, sf, "orders").select(F.lit(5).alias("v"))
    return distribution.quartile_segments(one, "v").select("segment", "name", "count", "all_same")


@query("axis_max", "SELECT 'o_totalprice' AS field, ceil(max(o_totalprice) / 10) * 10 AS axis_max FROM orders")
def axis_max(spark, sf):
    return distribution.axis_maximum(load(spark, sf, "orders"), "o_totalprice")


@query("cdf", f"""
SELECT value, {r("max(p) * 100.0")} AS percentile FROM (SELECT value, cume_dist() OVER (ORDER BY value) AS p FROM events) GROUP BY value""")
def cdf(spark, sf):
    return rounded(distribution.cdf(load(spark, sf, "events"), "value"), "percentile")


@query("percentile_rank", f"""
SELECT c_custkey, c_acctbal, {r("cume_dist() OVER (ORDER BY c_acctbal) * 100.0")} AS percentile FROM customer""")
def percentile_rank(spark, sf):
    return distribution.ranked_records(load(spark, sf, "customer"), "c_acctbal").select(
        "c_custkey", "c_acctbal", "percentile"
    )


@query("percentile_rank_reversed", f"""
SELECT p_partkey, p_size, {r("cume_dist() OVER (ORDER BY p_size DESC) * 100.0")} AS percentile,
 rank() OVER (ORDER BY p_size) AS best_rank FROM part""")
def percentile_rank_reversed(spark, sf):
    return distribution.ranked_records(load(spark, sf, "part"), "p_size", "lower-is-better").select(
        "p_partkey", "p_size", "percentile", "best_rank"
    )


@query("rank_interval", """
SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity DESC) AS best_rank,
 rank() OVER (ORDER BY l_quantity DESC) + count(*) OVER (PARTITION BY l_quantity) - 1 AS worst_rank FROM lineitem""")
def rank_interval(spark, sf):
    return distribution.ranked_records(load(spark, sf, "lineitem"), "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity", "best_rank", "worst_rank"
    )


# ---- samples, gate, pages -----------------------------------------------------------
def _numbered(spark, sf):
    return ordering.row_numbers(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])


_NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _row_id FROM orders)"


@query("row_numbers", f"WITH {_NUMBERED} SELECT o_orderkey, _row_id FROM n")
def row_numbers(spark, sf):
    return _numbered(spark, sf).select("o_orderkey", "_row_id")


_SAMPLE = """t AS (SELECT DISTINCT CASE WHEN (SELECT count(*) FROM orders) <= {s} THEN i
 ELSE cast((i * 2 * ((SELECT count(*) FROM orders) - 1) + {s} - 1) // (2 * ({s} - 1)) AS BIGINT) END AS _row_id
 FROM range(greatest({s}, (SELECT count(*) FROM orders))) g(i) WHERE i < {s})"""


@query("systematic_sample", f"WITH {_NUMBERED}, {_SAMPLE.format(s=777)} SELECT _row_id, o_orderkey FROM n JOIN t USING (_row_id)")
def systematic_sample(spark, sf):
    return sampling.systematic_sample(_numbered(spark, sf), 777).select("_row_id", "o_orderkey")


@query("systematic_indices", f"WITH {_SAMPLE.format(s=500)} SELECT _row_id FROM t")
def systematic_indices(spark, sf):
    return sampling.systematic_indices(spark, load(spark, sf, "orders").count(), 500)


@query("dataset_gate_rows", f"WITH {_NUMBERED}, {_SAMPLE.format(s=1000)} SELECT o_orderkey, o_totalprice FROM n JOIN t USING (_row_id)")
def dataset_gate_rows(spark, sf):
    return sampling.analysis_dataset(_numbered(spark, sf), SizeGate(sample_above=1000))[0].select("o_orderkey", "o_totalprice")


@query("record_page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20")
def record_page_after(spark, sf):
    return sampling.page_after(load(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


@query("row_numbers_tied", f"WITH r AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) SELECT s, n, sum(n) OVER (ORDER BY s) - n AS first_id, sum(n) OVER (ORDER BY s) - 1 AS last_id FROM r")
def row_numbers_tied(spark, sf):
    """Numbers of rows that tie in the order column, seen per tie."""
    got = ordering.row_numbers(load(spark, sf, "orders"), ["o_orderstatus"])
    return got.groupBy(F.col("o_orderstatus").alias("s")).agg(
        F.count_distinct("_row_id").alias("n"), F.min("_row_id").alias("first_id"), F.max("_row_id").alias("last_id")
    )


@query("dataset_gate", f"""
WITH {_NUMBERED}, {_SAMPLE.format(s=1000)}, c AS (SELECT count(*) AS n FROM orders), k AS (SELECT o_totalprice, o_orderkey FROM n JOIN t USING (_row_id))
SELECT CASE WHEN n > 1000 THEN 'ready_sampled' ELSE 'ready_full' END AS status,
 CASE WHEN n > 1000 THEN 'systematic_even_v1' END AS algorithm, n AS original_rows, least(n, 1000) AS analysed_rows,
 count(*) AS picked_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, {r("avg(o_totalprice)")} AS mean_price FROM c, k GROUP BY n""")
def dataset_gate(spark, sf):
    """The decision together with figures of the rows that it picked."""
    data, info = sampling.analysis_dataset(_numbered(spark, sf), SizeGate(sample_above=1000))
    picked = data.agg(
        F.count(F.lit(1)).alias("picked_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"),
        F.avg("o_totalprice").alias("mean_price"),
    )
    # one row each
    return rounded(info.withColumn("_one", F.lit(1)).join(picked.withColumn("_one", F.lit(1)), "_one").drop("_one"), "mean_price")


@query("dataset_gate_full", "SELECT o_orderkey FROM orders")
def dataset_gate_full(spark, sf):
    return sampling.analysis_dataset(load(spark, sf, "orders"))[0].select("o_orderkey")


@query("record_pages", "SELECT count(*) AS records, greatest(1, cast(ceil(count(*) / 20) AS BIGINT)) AS pages FROM events WHERE value > 100")
def record_pages(spark, sf):
    return sampling.page_count(load(spark, sf, "events").where("value > 100"))


@query("record_page", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40")
def record_page(spark, sf):
    got = sampling.page(load(spark, sf, "events"), [F.desc("value"), "event_id"], 2)
    return got.select("event_id", "value")


_LINE_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query("page_of_directory", f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS _row_id FROM lineitem), c AS (SELECT count(*) // 40 AS p FROM lineitem)
SELECT _row_id, {", ".join(_LINE_ORDER)} FROM n, c WHERE _row_id BETWEEN 20 * p AND 20 * p + 19""")
def page_of_directory(spark, sf):
    """The middle page of all line items, read from the one range that holds it."""
    path = scratch(spark, "pages")
    pages.write_pages(load(spark, sf, "lineitem"), _LINE_ORDER, path)
    return pages.read_page(spark, path, pages.row_count(spark, path) // 40).select("_row_id", *_LINE_ORDER)


@query("sample_of_directory", f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _row_id FROM orders), {_SAMPLE.format(s=333)}
SELECT _row_id, o_orderkey, o_totalprice FROM n JOIN t USING (_row_id)""")
def sample_of_directory(spark, sf):
    path = scratch(spark, "pages")
    pages.write_pages(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], path)
    return pages.read_sample(spark, path, 333).select("_row_id", "o_orderkey", "o_totalprice")


# ---- verdicts --------------------------------------------------------------------------
INPUTS = {"l_quantity": 40.0, "l_extendedprice": 20000.0, "l_discount": 0.05, "l_tax": 0.02}
_U = f"u AS ({sql_unpivot('lineitem', list(INPUTS))})"
_EXPLAIN = f"""{_U}, i AS (SELECT * FROM (VALUES (0, 'l_quantity', 40.0), (1, 'l_extendedprice', 20000.0), (2, 'l_discount', 0.05), (3, 'l_tax', 0.02)) t(ordinal, field, x)),
a AS (SELECT ordinal, field, x::DOUBLE AS x, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.95) AS q95,
  count(*) FILTER (CASE WHEN field = 'l_extendedprice' THEN value > x ELSE value < x END) AS passed,
  count(*) FILTER (CASE WHEN field = 'l_extendedprice' THEN value >= x ELSE value <= x END) AS within FROM u JOIN i USING (field) GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN field = 'l_tax' THEN 0.0 ELSE within / n * 100.0 END AS p FROM a)"""


@query("explain_values", f"""WITH {_EXPLAIN} SELECT ordinal, field, x AS user_value, {r("mean")} AS mean, CASE WHEN field = 'l_tax' THEN 0 ELSE passed END AS lower_count,
 {r("p")} AS percentile, CASE WHEN field = 'l_tax' THEN 'middle' WHEN p >= 90 THEN 'top10' WHEN p >= 75 THEN 'top25' WHEN p >= 25 THEN 'middle' WHEN p >= 10 THEN 'bottom25' ELSE 'bottom10' END AS tier,
 {r("x - mean")} AS diff_from_mean, {r("x - q75")} AS diff_from_p75, {r("x - q90")} AS diff_from_p90, {r("x - q95")} AS diff_from_p95, n AS valid_count FROM e""")
def explain_values(spark, sf):
    got = explain.explain_values(
        load(spark, sf, "lineitem"), INPUTS, rank_fields=["l_extendedprice"], directions={"l_tax": "neutral"}
    ).drop("tier_label")
    return rounded(got, "mean", "percentile", "diff_from_mean", "diff_from_p75", "diff_from_p90", "diff_from_p95")


@query("explain_summary", f"""WITH {_EXPLAIN} SELECT array_to_string(list(field ORDER BY p DESC, ordinal)[1:3], ',') AS top_fields,
 array_to_string(list(field ORDER BY p, ordinal DESC)[1:3], ',') AS bottom_fields, {r("avg(p)")} AS average_percentile, count(*) AS field_count, count(*) < 3 AS insufficient_data,
 [{r("q")} FOR q IN list(p ORDER BY p DESC, ordinal)[1:3]] AS top_percentiles, [{r("q")} FOR q IN list(p ORDER BY p, ordinal DESC)[1:3]] AS bottom_percentiles FROM e""")
def explain_summary(spark, sf):
    got = explain.explain_values(
        load(spark, sf, "lineitem"), INPUTS, rank_fields=["l_extendedprice"], directions={"l_tax": "neutral"}
    )
    got = rounded(explain.summarize_explanations(got), "average_percentile")
    return got.withColumns({c: F.transform(c, lambda p: half_up(p, 4)) for c in ("top_percentiles", "bottom_percentiles")})


@query("field_profile", f"""WITH {_EXPLAIN}, p2 AS (SELECT *, CASE WHEN field = 'l_tax' THEN within / n * 100.0 ELSE p END AS pp FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY pp DESC, ordinal) AS position FROM p2)
SELECT cast(position AS INT) AS position, field, x AS user_value, {r("pp")} AS percentile, {r("mean")} AS mean, n AS valid_count, CASE WHEN position <= 2 THEN 'advantage' ELSE 'weakness' END AS mark FROM k""")
def field_profile(spark, sf):
    got = explain.field_profile(load(spark, sf, "lineitem"), INPUTS, {"l_extendedprice": "lower_is_better"})
    return rounded(got, "percentile", "mean")


_RECORD_FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_RECORD_PERCENTILES = """
SELECT l_orderkey, l_linenumber,
  count(q) OVER (ORDER BY q) / count(q) OVER () * 100.0 AS p0, count(x) OVER (ORDER BY x DESC) / count(x) OVER () * 100.0 AS p1,
  CASE WHEN d IS NOT NULL THEN count(d) OVER (ORDER BY d NULLS LAST) / count(d) OVER () * 100.0 END AS p2,
  count(t) OVER (ORDER BY t) / count(t) OVER () * 100.0 AS p3
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS x, CASE WHEN l_discount > 0 THEN l_discount END AS d, l_tax AS t FROM lineitem)"""


@query("record_profiles", f"""WITH p AS ({_RECORD_PERCENTILES}), e AS (
SELECT *, list_sort([{{'k': -p, 'i': i}} FOR p, i IN [p0, p1, p2, p3] IF p IS NOT NULL]) AS o FROM p)
SELECT l_orderkey, l_linenumber, {r("p0")} AS percentile_l_quantity, {r("p1")} AS percentile_l_extendedprice, {r("p2")} AS percentile_l_discount, {r("p3")} AS percentile_l_tax,
 cast(len(o) AS INT) AS field_count, [['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][x.i] FOR x IN o[1:2]] AS advantages,
 [{r("-x.k")} FOR x IN o[1:2]] AS advantage_percentiles, [['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][x.i] FOR x IN list_reverse(o[-2:])] AS weaknesses,
 [{r("-x.k")} FOR x IN list_reverse(o[-2:])] AS weakness_percentiles, {r("(p0 + p1 + coalesce(p2, 0.0) + p3) / len(o)", 3)} AS average_percentile FROM e""")
def record_profiles(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    got = explain.record_profiles(lines, _RECORD_FIELDS, {"l_extendedprice": "lower_is_better"}, ids=["l_orderkey", "l_linenumber"])
    got = rounded(got, *[f"percentile_{f}" for f in _RECORD_FIELDS])
    got = rounded(got, "average_percentile", digits=3)
    return got.withColumns({c: F.transform(c, lambda p: half_up(p, 4)) for c in ("advantage_percentiles", "weakness_percentiles")})


@query("score_profile", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 * 100.0 AS q, l_extendedprice / 105000.0 * 100.0 AS p, CASE WHEN l_discount > 0 THEN l_discount / 0.1 * 100.0 END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d IS NULL THEN 2 ELSE 3 END AS field_count, {r("CASE WHEN d IS NULL THEN (q + p) / 2 ELSE (q + p + d) / 3 END", 3)} AS average_normalized,
 CASE WHEN q >= p AND q >= coalesce(d, 0) THEN 'l_quantity' WHEN p >= coalesce(d, 0) THEN 'l_extendedprice' ELSE 'l_discount' END AS best FROM s""")
def score_profile(spark, sf):
    got = explain.score_profiles(
        load(spark, sf, "lineitem"), {"l_quantity": 50.0, "l_extendedprice": 105000.0, "l_discount": 0.1},
        ids=["l_orderkey", "l_linenumber"],
    )
    return rounded(got, "average_normalized", digits=3).select(
        "l_orderkey", "l_linenumber", "field_count", "average_normalized",
        F.substring_index("advantages", ",", 1).alias("best"),
    )
