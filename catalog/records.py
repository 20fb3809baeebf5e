"""Record lookup and locator analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLES, load, query, r, rounded
from cellgrain.operators import lookup
from cellgrain.plans import locator, profile


@query("lookup_field", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000042'")
def lookup_field(spark, sf):
    # full-width letters and separators still find the record
    return lookup.lookup(load(spark, sf, "customer"), "c_name", " ＣＵＳＴＯＭＥＲ#0000-00042 ").select("c_custkey", "c_name")


@query("lookup_digits", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE cast(o_orderdate AS DATE) = DATE '1997-05-28'")
def lookup_digits(spark, sf):
    df = load(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return lookup.lookup(df, "day", "19970528", "time").select("o_orderkey", "day")


@query("lookup_combo", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def lookup_combo(spark, sf):
    got = lookup.lookup_combo(load(spark, sf, "customer"), {"c_mktsegment": "building", "c_nationkey": "７", "c_name": " "})
    return got.select("c_custkey", "c_name")


@query("lookup_many", """
SELECT p_partkey, c_custkey FROM part JOIN customer ON c_custkey = p_partkey""")
def lookup_many(spark, sf):
    asked = load(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("customer # "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("query")
    )
    return lookup.lookup_many(load(spark, sf, "customer"), "c_name", asked).select("p_partkey", "c_custkey")


@query("lookup_many_digits", """
SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey""")
def lookup_many_digits(spark, sf):
    """Identifiers written with other separators are found by their digits."""
    asked = load(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("No."), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("query")
    )
    return lookup.lookup_many(load(spark, sf, "customer"), "c_name", asked, semantic="identifier").select("o_orderkey", "c_custkey")


@query("lookup_cascade", "SELECT c_custkey, 2 AS stage, 'c_mktsegment' AS stage_field FROM customer WHERE c_mktsegment = 'MACHINERY'")
def lookup_cascade(spark, sf):
    got = lookup.lookup_cascade(
        load(spark, sf, "customer"), "machinery", id_field="c_name",
        candidates=[("c_mktsegment", "group")], others=["c_nationkey", "c_acctbal"],
    )
    return got.select("c_custkey", "stage", "stage_field")


@query("fill_values", "SELECT c_custkey, c_acctbal, cast(c_nationkey AS DOUBLE) AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'note' ELSE '' END AS empty FROM customer WHERE c_mktsegment = 'BUILDING'")
def fill_values(spark, sf):
    df = lookup.lookup(load(spark, sf, "customer"), "c_mktsegment", "building").withColumn(
        "note", F.when(F.col("c_custkey") % 2 == 1, F.lit("x"))
    )
    got = lookup.fill_values(df, ["c_acctbal", "c_nationkey", "note"])
    return got.select("c_custkey", "c_acctbal", "c_nationkey", F.array_join("empty_fields", ",").alias("empty"))


def _people(spark, sf):
    """Customers under the headers of a class list."""
    return load(spark, sf, "customer").select(
        F.col("c_name").alias("学号"), F.col("c_mktsegment").alias("班级"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")).alias("日期"),
        F.col("c_acctbal").alias("余额"), F.col("c_custkey").alias("key"),
    )


_CODE = "regexp_full_match({}, '[0-9A-Za-z][0-9A-Za-z._\\-]{{2,29}}')"
_BALANCE = f"""(CASE WHEN floor(c_acctbal) = c_acctbal THEN cast(cast(c_acctbal AS bigint) AS varchar) ELSE cast(c_acctbal AS varchar) END)"""
_LOCATOR = f"""n AS (SELECT count(*) AS n, count(DISTINCT c_name) AS c, count(DISTINCT c_mktsegment) AS s, count(DISTINCT c_custkey % 28) AS d, count(DISTINCT c_acctbal) AS b, count(DISTINCT c_custkey) AS k,
 count(*) FILTER ({_CODE.format("cast(c_custkey AS varchar)")}) AS key_codes, count(*) FILTER ({_CODE.format(_BALANCE)}) AS codes FROM customer),
v AS (SELECT n, unnest([0, 1, 2, 3, 4]) AS ordinal, unnest(['学号', '班级', '日期', '余额', 'key']) AS field, unnest([c, s, d, b, k]) AS u,
 unnest([0, n, 0, codes, key_codes]) AS code, unnest(['学号', '班级', '日期', NULL, NULL]) AS matched_alias, unnest(['student_id', 'class', 'time', '余额', 'key']) AS normalized_name FROM n),
t AS (SELECT *, CASE WHEN field = '日期' THEN 'date' WHEN code / n >= 0.5 THEN 'code' WHEN u / n <= 0.15 THEN 'lowCardinality' ELSE 'mixed' END AS value_type FROM v),
z AS (SELECT *, CASE WHEN field = '学号' THEN 'identifier' WHEN field = '班级' THEN 'group' WHEN field = '日期' THEN 'time' WHEN value_type = 'code' AND u / n >= 0.9 AND n >= 3 THEN 'identifier' ELSE 'other' END AS semantic FROM t),
l AS (SELECT *, CASE field WHEN '学号' THEN 0.9 + CASE WHEN u / n >= 0.9 THEN 0.04 ELSE 0 END WHEN '班级' THEN 0.84 + CASE WHEN value_type = 'lowCardinality' THEN 0.04 ELSE 0 END WHEN '日期' THEN 0.85
  ELSE CASE WHEN semantic = 'identifier' THEN 0.78 ELSE 0.2 END END AS confidence,
 CASE field WHEN '学号' THEN CASE WHEN u / n >= 0.9 THEN 'named_unique' ELSE 'named_repeated' END WHEN '班级' THEN 'named_group' WHEN '日期' THEN 'named' ELSE CASE WHEN semantic = 'identifier' THEN 'unique_codes' ELSE 'none' END END AS ability FROM z)"""


@query("locator_fields", f"""
WITH {_LOCATOR} SELECT ordinal, field, normalized_name, semantic, {r("confidence", 2)} AS confidence, n AS total_rows, n AS non_empty, u AS unique_count, {r("u / n", 2)} AS uniqueness,
 value_type, matched_alias, ability, n - u AS repeated_cells, semantic <> 'other' AS is_candidate FROM l""")
def locator_fields(spark, sf):
    counts = profile.column_counts(_people(spark, sf))
    return rounded(locator.locator_fields(counts), "confidence", "uniqueness", digits=2)


query("locator_fields_whole", ORACLES["locator_fields"])(locator_fields)


@query("locator_report", f"""
WITH {_LOCATOR}, w AS (SELECT '学号' AS field, c_custkey AS id, c_name AS cell FROM customer UNION ALL SELECT '班级', c_custkey, c_mktsegment FROM customer
 UNION ALL SELECT '日期', c_custkey, '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') FROM customer UNION ALL SELECT '余额', c_custkey, {_BALANCE} FROM customer UNION ALL SELECT 'key', c_custkey, c_custkey::VARCHAR FROM customer),
f AS (SELECT field, cell, min(id) AS id FROM w GROUP BY 1, 2), g AS (SELECT field, list(cell ORDER BY id)[1:3] AS sample_values FROM f GROUP BY field),
h AS (SELECT field, count(*) FILTER (lower(cell) = 'building') AS matched_count FROM w GROUP BY field)
SELECT cast(row_number() OVER (ORDER BY {r("confidence", 2)} DESC, ordinal) AS INT) AS position, field, semantic, {r("confidence", 2)} AS confidence, {r("u / n", 2)} AS uniqueness, matched_count, sample_values, ability, 5 AS scanned_fields,
 {r("u / n", 2)} >= 0.95 AS is_unique_field, first(CASE WHEN semantic = 'identifier' AND {r("u / n", 2)} >= 0.95 THEN field END IGNORE NULLS) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS unique_field,
 '未识别出明显的标识/姓名/分组字段，请检查表头或数据。' AS suggestion FROM l JOIN g USING (field) JOIN h USING (field) WHERE semantic <> 'other'""")
def locator_report(spark, sf):
    return rounded(locator.locator_report(_people(spark, sf), "building", row_id="key"), "confidence", "uniqueness", digits=2)


query("locator_report_whole", ORACLES["locator_report"])(locator_report)
