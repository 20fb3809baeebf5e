"""Column profiles, schema inference and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIRTY, ORACLES, QUERIES, dirty_orders, load, query, r, rounded, sql_date_ms, sql_empty, sql_num, sql_text, sql_unpivot,
)
from cellgrain.functions.text import WHITESPACE
from cellgrain.operators.cells import text_of
from cellgrain.plans import legacy, overview, profile, schema
from cellgrain.plans.rules import EDUCATION_TEMPLATE
from cellgrain.plans.schema import Override

TABLES = {
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "double"), ("o_orderdate", "time"), ("o_orderpriority", "text")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "text")],
    "part": [("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"), ("p_retailprice", "double")],
    "events": [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "text"), ("value", "double"), ("props", "text")],
}


def _fields(table: str) -> list[str]:
    return [f for f, _ in TABLES[table]]


def _counts(spark, sf, table: str, approx: bool = False):
    return profile.column_counts(load(spark, sf, table), _fields(table), approx)


def _sql_counts(table: str) -> str:
    """The SQL twin of the counters, one row per column."""
    cells = " UNION ALL ".join(
        f"SELECT {k} AS ordinal, '{f}' AS field, '{kind}' AS kind, coalesce(trim({sql_text(f, kind)}), '') AS cell FROM {table}"
        for k, (f, kind) in enumerate(TABLES[table])
    )
    return f"""x AS ({cells}), v AS (SELECT *, {sql_num("cell")} AS num, regexp_full_match(cell, '\\d+') AS dig FROM x),
k AS (SELECT ordinal, field, kind, count(*) AS total, count(*) FILTER (cell <> '') AS filled, count(DISTINCT cell) AS unique_all,
 count(DISTINCT cell) FILTER (cell <> '') AS unique_filled, count(*) FILTER (cell IN ('', 'null', 'undefined')) AS missing,
 count(DISTINCT cell) FILTER (cell NOT IN ('', 'null', 'undefined')) AS unique_present, count(*) FILTER ({sql_empty("cell")}) AS empty_like,
 count(*) FILTER (regexp_full_match(cell, '[一-龥]{{2,4}}')) AS chinese_name, count(*) FILTER (regexp_matches(cell, '班|级|高一|高二|高三')) AS class_label,
 count(*) FILTER (kind = 'time' AND cell <> '' OR regexp_full_match(cell, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}|\\d{{8}}')) AS compact_date,
 count(*) FILTER (kind = 'time' AND cell <> '' OR {sql_date_ms("cell")} IS NOT NULL) AS temporal,
 count(num) AS numeric, count(*) FILTER (floor(num) = num) AS integer, count(*) FILTER (dig AND length(cell) >= 6) AS long_digits,
 count(*) FILTER (floor(num) = num AND num >= 1 AND num <= 2 * (SELECT count(*) FROM {table})) AS small_integer,
 count(*) FILTER (num BETWEEN 0 AND 1000) AS score_range, count(*) FILTER (dig) AS digit_cells,
 coalesce(sum(length(cell)) FILTER (dig), 0)::BIGINT AS digit_length, sum(length(cell))::BIGINT AS length,
 count(*) FILTER (length(cell) >= 50) AS long_text, count(*) FILTER (regexp_full_match(cell, '[0-9A-Za-z][0-9A-Za-z._\\-]{{2,29}}')) AS code,
 min(num) AS min, max(num) AS max, avg(num) AS mean FROM v GROUP BY 1, 2, 3)"""


_STRUCT = """s AS (SELECT *, numeric / total AS nr, coalesce(integer / nullif(numeric, 0), 0) AS ir, unique_all / total AS ur,
 long_digits / total AS ldr, length / total AS al, coalesce(small_integer / nullif(numeric, 0), 0) AS sir FROM k)"""


def _sql_profile(table: str) -> str:
    return f"WITH {_sql_counts(table)} SELECT ordinal, field, total, filled, unique_all, unique_filled, missing, numeric, integer, long_digits, small_integer, score_range, digit_cells, digit_length, length, long_text, code, min, max, {r('mean')} AS mean, unique_present, empty_like, temporal, chinese_name, class_label, compact_date FROM k"


@query("column_profile", _sql_profile("orders"))
def column_profile(spark, sf):
    return rounded(_counts(spark, sf, "orders"), "mean").drop("kind")


@query("column_profile_dates", f"WITH {DIRTY}, x AS (SELECT 'price_text' AS field, coalesce(trim(price_text), '') AS cell FROM d UNION ALL SELECT 'date_text', coalesce(trim(date_text), '') FROM d)"
       f" SELECT field, count(*) AS total, count(*) FILTER (cell <> '') AS filled, count(*) FILTER ({sql_date_ms('cell')} IS NOT NULL) AS temporal,"
       " count(*) FILTER (regexp_full_match(cell, '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|\\d{8}')) AS compact_date,"
       f" count(*) FILTER ({sql_num('cell')} IS NOT NULL) AS numeric, count(*) FILTER ({sql_empty('cell')}) AS empty_like FROM x GROUP BY 1")
def column_profile_dates(spark, sf):
    got = profile.column_counts(dirty_orders(spark, sf), ["price_text", "date_text"])
    return got.select("field", "total", "filled", "temporal", "compact_date", "numeric", "empty_like")


@query("document_profile", f"""
SELECT field, count(*) AS total, count(DISTINCT cell) AS unique_all, sum(length(cell))::BIGINT AS length, count(*) FILTER (length(cell) >= 50) AS long_text
FROM (SELECT 'text' AS field, trim(text, '{WHITESPACE}') AS cell FROM documents
 UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY field""")
def document_profile(spark, sf):
    got = profile.column_counts(load(spark, sf, "documents"), ["text", "lang", "source"])
    return got.select("field", "total", "unique_all", "length", "long_text")


# A sketch may differ from the exact count, so only the exact counters are compared.
@query("column_profile_approx", f"WITH {_sql_counts('customer')} SELECT field, total, filled, numeric, length FROM k")
def column_profile_approx(spark, sf):
    return _counts(spark, sf, "customer", approx=True).select("field", "total", "filled", "numeric", "length")


@query("structure_features", f"""WITH {_sql_counts('customer')}, {_STRUCT} SELECT ordinal, field, {r("nr")} AS numeric_ratio, {r("ir")} AS integer_ratio, {r("ur")} AS unique_ratio,
 {r("ldr")} AS long_digit_ratio, {r("al")} AS avg_length, {r("sir")} AS small_integer_ratio, min, max, {r("mean")} AS mean FROM s""")
def structure_features(spark, sf):
    return rounded(
        profile.structure_features(_counts(spark, sf, "customer")).drop("kind"), "numeric_ratio", "integer_ratio",
        "unique_ratio", "long_digit_ratio", "avg_length", "small_integer_ratio", "mean",
    )


_PATTERN = """CASE WHEN long_digits / total > 0.5 THEN 'longNumber' WHEN nr > 0.5 THEN CASE WHEN sir > 0.7 THEN 'rankLike'
 WHEN score_range / numeric > 0.7 THEN 'scoreLike' ELSE 'mixed' END ELSE 'unknown' END"""


@query("content_features", f"""WITH {_sql_counts('part')}, {_STRUCT} SELECT ordinal, field, {r("nr")} AS numeric_ratio, {r("ir")} AS integer_ratio,
 {r("coalesce((numeric - integer) / nullif(numeric, 0), 0)")} AS decimal_ratio, {r("ur")} AS unique_ratio, min, max, {r("mean")} AS mean, {r("al")} AS avg_length, {_PATTERN} AS value_pattern FROM s""")
def content_features(spark, sf):
    return rounded(
        profile.content_features(_counts(spark, sf, "part")), "numeric_ratio", "integer_ratio", "decimal_ratio",
        "unique_ratio", "mean", "avg_length",
    )


@query("value_status_counts", f"""WITH {_sql_counts('events')} SELECT ordinal, field, numeric AS valid_count, total - filled AS empty_count,
 filled - numeric AS invalid_count, total - numeric AS text_count FROM k""")
def value_status_counts(spark, sf):
    return profile.value_status_counts(_counts(spark, sf, "events"))


@query("field_statistics", f"WITH {_sql_counts('customer')} SELECT ordinal, field, missing AS missing_count, unique_filled AS unique_count FROM k")
def field_statistics(spark, sf):
    return profile.field_statistics(_counts(spark, sf, "customer"))


@query("sample_values", """
WITH x AS (SELECT 'c_name' AS field, c_custkey, c_name AS cell FROM customer UNION ALL SELECT 'c_nationkey', c_custkey, cast(c_nationkey AS varchar) FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c_custkey) AS n FROM x)
SELECT field, string_agg(cell, '|' ORDER BY n) AS samples FROM k WHERE n <= 3 GROUP BY field""")
def sample_values(spark, sf):
    got = profile.sample_values(load(spark, sf, "customer"), ["c_name", "c_nationkey"], "c_custkey")
    return got.select("field", F.array_join("sample_values", "|").alias("samples"))


def _sql_types(table: str) -> str:
    return f"""{_sql_counts(table)}, t AS (SELECT *, unique_filled / filled AS u FROM k),
 f AS (SELECT *, CASE WHEN filled = 0 THEN 'invalid' WHEN kind = 'time' THEN 'temporal' WHEN u >= 0.9 AND digit_cells / filled >= 0.8 AND digit_length / digit_cells >= 6 THEN 'identifier'
  WHEN u >= 0.9 AND (contains(field, 'id') OR contains(field, 'code') OR contains(field, 'no') OR contains(field, 'num')) THEN 'identifier'
  WHEN numeric / filled >= 0.7 THEN 'numerical' WHEN length / filled >= 50 AND long_text / filled >= 0.5 THEN 'text'
  WHEN unique_filled <= 50 AND u <= 0.5 THEN 'categorical' ELSE 'invalid' END AS feature_type FROM t)"""


_CONF = """CASE WHEN feature_type = 'identifier' THEN CASE WHEN digit_cells / filled >= 0.8 AND digit_length / digit_cells >= 6 THEN 0.95 ELSE 0.85 END
 WHEN feature_type = 'temporal' THEN 0.95 WHEN feature_type = 'numerical' THEN least(0.99, numeric / filled) WHEN feature_type = 'text' THEN 0.85 WHEN feature_type = 'categorical' THEN least(0.9, 1 - u) ELSE 0.5 END"""

for _table in ("orders", "events", "part"):
    def _feature_types(spark, sf, table=_table):
        got = profile.feature_types(_counts(spark, sf, table))
        return rounded(got, "confidence").drop("reason")

    query(f"feature_types_{_table}", f"WITH {_sql_types(_table)} SELECT ordinal, field, feature_type, {r(_CONF)} AS confidence FROM f")(_feature_types)


# ---- schema ----------------------------------------------------------------------------
def _sql_schema(table: str) -> str:
    """Generic inference for columns whose names only ever match the 'id' word."""
    return f"""{_sql_counts(table)}, {_STRUCT}, g AS (SELECT *, CASE WHEN kind = 'time' THEN 'typed' WHEN contains(field, 'id') THEN 'name' WHEN nr > 0.8 AND ur > 0.9 AND ldr > 0.5 THEN 'code'
  WHEN nr > 0.8 AND ir > 0.9 AND sir > 0.7 AND ur > 0.5 THEN 'sequence' WHEN nr > 0.8 THEN 'measure' WHEN nr > 0.5 AND ur < 0.2 THEN 'midcat' WHEN nr > 0.5 THEN 'midnum'
  WHEN nr < 0.3 AND ur > 0.8 AND al > 10 THEN 'prose' WHEN nr < 0.3 AND ur < 0.3 THEN 'lowcat' WHEN nr < 0.3 THEN 'words' ELSE 'unclear' END AS g FROM s),
 i AS (SELECT ordinal, field, CASE WHEN g IN ('name', 'code') THEN 'identifier' WHEN g IN ('sequence', 'measure', 'midnum') THEN 'number' WHEN g IN ('midcat', 'lowcat') THEN 'category'
   WHEN g IN ('prose', 'words') THEN 'text' WHEN g = 'typed' THEN 'datetime' ELSE 'unknown' END AS data_type, CASE WHEN g IN ('name', 'code') THEN 'identifier' WHEN g IN ('sequence', 'measure', 'midnum') THEN 'metric'
   WHEN g IN ('midcat', 'lowcat') THEN 'dimension' WHEN g IN ('prose', 'words') THEN 'description' WHEN g = 'typed' THEN 'time' ELSE 'unspecified' END AS role,
  CASE WHEN g IN ('sequence', 'measure', 'midnum', 'unclear') THEN 'unspecified' ELSE 'neutral' END AS direction, CASE WHEN g = 'name' THEN 'name_rule' ELSE 'structure' END AS source,
  CASE WHEN g IN ('name', 'code', 'measure', 'typed') THEN 'high' WHEN g = 'words' THEN 'low' WHEN g = 'unclear' THEN 'unknown' ELSE 'medium' END AS confidence FROM g)"""


_SCHEMA = ("ordinal", "field", "data_type", "role", "direction", "source", "confidence")

for _table in TABLES:
    def _infer(spark, sf, table=_table):
        return schema.infer_schema(_counts(spark, sf, table)).select(*_SCHEMA)

    query(f"infer_schema_{_table}", f"WITH {_sql_schema(_table)} SELECT * FROM i")(_infer)


@query("infer_schema_typed", """
SELECT unnest([0, 1]) AS ordinal, unnest(['ts', 'late']) AS field, unnest(['datetime', 'boolean']) AS data_type, unnest(['time', 'dimension']) AS role, count(*) AS rows FROM events""")
def infer_schema_typed(spark, sf):
    df = load(spark, sf, "events").select("ts", (F.col("value") > 50).alias("late"))
    counts = profile.column_counts(df)
    return schema.infer_schema(counts).join(counts.select("field", F.col("total").alias("rows")), "field").select(
        "ordinal", "field", "data_type", "role", "rows"
    )


@query("resolve_overrides", f"""WITH {_sql_schema('orders')} SELECT ordinal, field, CASE field WHEN 'o_custkey' THEN 'category' ELSE data_type END AS data_type,
 CASE field WHEN 'o_custkey' THEN 'dimension' WHEN 'o_orderpriority' THEN 'unspecified' ELSE role END AS role,
 CASE field WHEN 'o_totalprice' THEN 'lower_is_better' ELSE direction END AS direction, field = 'o_orderstatus' AS ignored,
 CASE WHEN field IN ('o_custkey', 'o_orderpriority', 'o_totalprice', 'o_orderstatus') THEN 'user' ELSE source END AS source FROM i""")
def resolve_overrides(spark, sf):
    inferred = schema.infer_schema(_counts(spark, sf, "orders"))
    resolved = schema.resolve_schema(inferred, {
        "o_custkey": Override("category", "dimension"), "o_orderpriority": Override(role="unspecified"),
        "o_totalprice": Override(direction="lower_is_better"), "o_orderstatus": Override(ignored=True),
    })
    return resolved.select("ordinal", "field", "data_type", "role", "direction", "ignored", "source")


@query("schema_participation", f"""WITH {_sql_schema('customer')} SELECT ordinal, field, role, role NOT IN ('ignored', 'description', 'unspecified') AS analysable,
 direction NOT IN ('neutral', 'unspecified') AS evaluated FROM i""")
def schema_participation(spark, sf):
    resolved = schema.resolve_schema(schema.infer_schema(_counts(spark, sf, "customer")))
    return schema.with_participation(resolved).select("ordinal", "field", "role", "analysable", "evaluated")


EDU = {"o_orderkey": "学号", "o_custkey": "班级名次", "o_orderstatus": "班级", "o_totalprice": "总分", "o_orderpriority": "选科", "o_orderdate": "政策加分"}


def _education(spark, sf):
    df = load(spark, sf, "orders")
    price = (F.floor("o_totalprice") % 151).cast("string")
    return df.select(*[
        (price if c == "o_totalprice" else text_of(df, c)).alias(name) for c, name in EDU.items()
    ])


@query("template_rules", """
WITH n AS (SELECT count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_orderstatus) AS c, count(DISTINCT floor(o_totalprice) % 151) AS d, count(DISTINCT o_orderpriority) AS e, count(DISTINCT o_orderdate) AS f FROM orders)
SELECT unnest(['学号', '班级名次', '班级', '总分', '选科', '政策加分']) AS field, unnest(['identifier', 'number', 'category', 'number', 'category', 'number']) AS data_type,
 unnest(['identifier', 'metric', 'dimension', 'metric', 'dimension', 'metric']) AS role, unnest(['neutral', 'lower_is_better', 'neutral', 'higher_is_better', 'neutral', 'higher_is_better']) AS direction,
 'template' AS source, unnest([a, b, c, d, e, f]) AS unique_filled FROM n""")
def template_rules(spark, sf):
    counts = profile.kept_small(profile.column_counts(_education(spark, sf)))
    resolved = schema.resolve_schema(schema.infer_schema(counts), template=EDUCATION_TEMPLATE)
    return resolved.join(counts.select("field", "unique_filled"), "field").select(
        "field", "data_type", "role", "direction", "source", "unique_filled"
    )


@query("dimension_columns", f"WITH {_sql_schema('part')} SELECT ordinal, field, role FROM i WHERE role IN ('dimension', 'time')")
def dimension_columns(spark, sf):
    return schema.dimension_candidates(schema.resolve_schema(schema.infer_schema(_counts(spark, sf, "part"))))


# ---- older field metadata -----------------------------------------------------------------
def _sql_legacy(table: str) -> str:
    """Content branch only: none of these headers holds an education word."""
    return f"""{_sql_counts(table)}, {_STRUCT}, p AS (SELECT *, {_PATTERN} AS vp FROM s), c AS (SELECT *, CASE WHEN nr > 0.5 AND vp = 'longNumber' AND ur > 0.8 THEN 'identity'
  WHEN nr > 0.5 AND ur < 0.2 THEN 'category' WHEN nr > 0.5 THEN 'unknown' WHEN 1 - nr > 0.6 AND ur < 0.2 THEN 'category' WHEN 1 - nr > 0.6 THEN 'text' ELSE 'unknown' END AS type FROM p),
 l AS (SELECT ordinal, field, type, CASE type WHEN 'identity' THEN 'identity' WHEN 'category' THEN 'textMeta' WHEN 'text' THEN 'textMeta' ELSE 'unknown' END AS role,
  CASE type WHEN 'identity' THEN least(0.95, least(0.95, 0.8 + CASE WHEN ur > 0.9 THEN 0.05 ELSE 0 END) + 0.1) WHEN 'category' THEN 0.7 WHEN 'text' THEN 0.7 ELSE CASE WHEN nr > 0.5 THEN 0.5 ELSE 0.3 END END AS confidence,
  numeric AS valid_count, nr, ur, min, max, mean, vp FROM c)"""


def _sql_legacy_fields(table: str) -> str:
    return f"WITH {_sql_legacy(table)} SELECT ordinal, field, type, role, {r('confidence', 2)} AS confidence, valid_count, vp AS value_pattern FROM l"


for _table in ("orders", "customer"):
    def _legacy(spark, sf, table=_table):
        got = legacy.classify_fields(_counts(spark, sf, table))
        return rounded(got, "confidence", digits=2).select(
            "ordinal", "field", "type", "role", "confidence", "valid_count", "value_pattern"
        )

    query(f"legacy_fields_{_table}", _sql_legacy_fields(_table))(_legacy)


@query("legacy_fields_education", """
WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS u FROM orders)
SELECT unnest(['学号', '班级名次', '班级', '总分', '选科', '政策加分']) AS field, unnest(['identity', 'rank', 'identity', 'score', 'category', 'bonus']) AS type,
 unnest(['identity', 'rank', 'identity', 'primaryTotal', 'textMeta', 'adjustment']) AS role, n AS cells FROM n""")
def legacy_fields_education(spark, sf):
    got = legacy.classify_fields(profile.column_counts(_education(spark, sf)))
    return got.select("field", "type", "role", (F.col("valid_count") + F.col("text_count")).alias("cells"))


@query("legacy_to_schema", f"""WITH {_sql_legacy('customer')} SELECT ordinal, field, CASE type WHEN 'identity' THEN 'identifier' WHEN 'category' THEN 'category' WHEN 'text' THEN 'text' ELSE 'unknown' END AS data_type,
 CASE role WHEN 'identity' THEN 'identifier' WHEN 'textMeta' THEN 'description' ELSE 'unspecified' END AS role, 'unspecified' AS direction,
 CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM l""")
def legacy_to_schema(spark, sf):
    got = legacy.to_schema(legacy.classify_fields(_counts(spark, sf, "customer")))
    return got.select("ordinal", "field", "data_type", "role", "direction", "confidence")


_SCORE = """CASE WHEN min IS NOT NULL AND min <> max THEN least(least((max - min) / CASE WHEN mean <> 0 THEN abs(mean) ELSE 1 END, 10) / 5, 1) ELSE 0 END AS va,
 CASE WHEN ur > 0.7 THEN least((ur - 0.7) / 0.3, 1) ELSE 0 END AS up, CASE WHEN vp = 'rankLike' AND ur > 0.5 THEN least(ur, 0.8) ELSE 0 END AS mp,
 CASE WHEN role IN ('identity', 'textMeta') THEN 0.0 WHEN nr > 0.5 THEN 0.5 ELSE 0.1 END AS ns"""


@query("analytic_scores", f"""WITH {_sql_legacy('customer')}, w AS (SELECT *, {_SCORE} FROM l), z AS (SELECT *, nr * 0.30 + va * 0.20 + (1 - up) * 0.25 + (1 - mp) * 0.15 + ns * 0.10 AS s FROM w)
SELECT ordinal, field, {r("s", 3)} AS score, s >= 0.5 AS analysable, {r("nr", 3)} AS numeric, {r("va", 3)} AS variance, {r("up", 3)} AS uniqueness_penalty, {r("mp", 3)} AS monotonic_penalty, {r("ns", 3)} AS name_signal FROM z""")
def analytic_scores(spark, sf):
    return legacy.analytic_scores(legacy.classify_fields(_counts(spark, sf, "customer"))).drop("reason")


@query("analytic_scores_numeric_heavy", f"""WITH {_sql_legacy('orders')}, w AS (SELECT *, {_SCORE} FROM l), cut AS (SELECT ordinal, field, {r("nr", 3)} AS nr, {r("va", 3)} AS va, {r("up", 3)} AS up, {r("mp", 3)} AS mp, {r("ns", 3)} AS ns FROM w),
z AS (SELECT *, nr * 0.35 + va * 0.30 + (1 - up) * 0.20 + (1 - mp) * 0.10 + ns * 0.05 AS s FROM cut) SELECT ordinal, field, {r("s", 3)} AS score, s >= 0.5 AS analysable FROM z""")
def analytic_scores_numeric_heavy(spark, sf):
    got = legacy.analytic_scores(legacy.classify_fields(_counts(spark, sf, "orders")), legacy.NUMERIC_HEAVY_WEIGHTS)
    return got.select("ordinal", "field", "score", "analysable")


@query("recommended_fields", """
SELECT 1 AS position, '总分' AS field, 'primaryTotal' AS role, 1 AS priority, count(*) AS cells FROM orders UNION ALL SELECT 2, '班级名次', 'rank', 2, count(*) FROM orders""")
def recommended_fields(spark, sf):
    counts = profile.kept_small(profile.column_counts(_education(spark, sf)))
    got = legacy.recommended_fields(legacy.classify_fields(counts))
    return got.join(counts.select("field", F.col("total").alias("cells")), "field").select(
        "position", "field", "role", "priority", "cells"
    )


@query("dimension_candidates", f"""WITH {_sql_legacy('customer')} SELECT ordinal, field, role, {r("ur")} AS unique_ratio,
 CASE WHEN ur >= 0.95 THEN 'excluded' WHEN ur >= 0.8 THEN 'warning' ELSE 'none' END AS risk_level FROM l WHERE role IN ('textMeta', 'identity')""")
def dimension_candidates(spark, sf):
    return rounded(legacy.dimension_risks(legacy.classify_fields(_counts(spark, sf, "customer"))), "unique_ratio")


@query("parse_report", f"""WITH {_sql_legacy('customer')} SELECT (SELECT count(*) FROM customer) AS data_rows, count(*) AS field_count, 0::BIGINT AS recommended_count,
 count(*) FILTER (role = 'identity') AS identity_count, count(*) FILTER (role = 'textMeta') AS "textMeta_count", count(*) FILTER (role = 'unknown') AS unknown_count,
 count(*) FILTER (confidence < 0.7) AS low_confidence_count FROM l""")
def parse_report(spark, sf):
    counts = _counts(spark, sf, "customer")
    rows = counts.agg(F.max("total").alias("n")).scalar()
    return legacy.report_summary(legacy.classify_fields(counts), rows).select(
        "data_rows", "field_count", "recommended_count", "identity_count", "textMeta_count", "unknown_count",
        "low_confidence_count",
    )


@query("parse_report_fields", f"""WITH {_sql_legacy('orders')} SELECT ordinal, field, type, role, false AS recommended, true AS hidden,
 CASE role WHEN 'identity' THEN '标识/身份字段，不参与数值分析' WHEN 'textMeta' THEN '文本/元数据字段，不适合数值统计' ELSE '字段类型未知，需要人工确认' END AS hidden_reason FROM l""")
def parse_report_fields(spark, sf):
    return legacy.report_fields(legacy.classify_fields(_counts(spark, sf, "orders"))).select(
        "ordinal", "field", "type", "role", "recommended", "hidden", "hidden_reason"
    )


@query("analysable_fields", f"WITH {_sql_schema('orders')} SELECT ordinal, field, role FROM i WHERE role = 'metric'")
def analysable_fields(spark, sf):
    counts = profile.kept_small(_counts(spark, sf, "orders"))
    return schema.analysable_fields(schema.resolve_schema(schema.infer_schema(counts)), counts)


@query("fields_by_role", f"""WITH {_sql_schema('part')} SELECT CASE WHEN role IN ('metric', 'dimension', 'identifier', 'time', 'description') THEN role ELSE 'others' END AS role_group,
 string_agg(field, ',' ORDER BY ordinal) AS fields FROM i GROUP BY 1""")
def fields_by_role(spark, sf):
    got = schema.fields_by_role(schema.resolve_schema(schema.infer_schema(_counts(spark, sf, "part"))))
    return got.select("role_group", F.array_join("fields", ",").alias("fields"))


@query("semantic_definitions", """
WITH n AS (SELECT count(DISTINCT o_orderkey) = count(*) AS key FROM orders)
SELECT unnest(['学号', '班级名次', '班级', '总分', '选科', '政策加分']) AS field, unnest(['entity', 'metric', 'dimension', 'metric', 'dimension', 'metric']) AS kind,
 unnest([CASE WHEN key THEN 'id' ELSE 'identity' END, 'rank', 'group', 'total', 'category', 'adjustment']) AS type,
 unnest([NULL, 'lower-is-better', NULL, 'higher-is-better', NULL, 'higher-is-better']) AS direction, unnest([key, NULL, NULL, NULL, NULL, NULL]) AS primary_key FROM n""")
def semantic_definitions(spark, sf):
    fields = legacy.classify_fields(profile.column_counts(_education(spark, sf)))
    return legacy.semantic_definitions(fields).select("field", "kind", "type", "direction", "primary_key")


# The names under which these were first registered over all columns.
for _table in ("orders", "events"):
    def _profile_whole(spark, sf, table=_table):
        return rounded(_counts(spark, sf, table), "mean").drop("kind")

    def _legacy_whole(spark, sf, table=_table):
        got = legacy.classify_fields(_counts(spark, sf, table))
        return rounded(got, "confidence", digits=2).select(
            "ordinal", "field", "type", "role", "confidence", "valid_count", "value_pattern"
        )

    query(f"column_profile_{_table}_whole", _sql_profile(_table))(_profile_whole)
    query(f"legacy_fields_{_table}_whole", _sql_legacy_fields(_table))(_legacy_whole)
    for _name in ("feature_types", "infer_schema"):
        query(f"{_name}_{_table}_whole", ORACLES[f"{_name}_{_table}"])(QUERIES[f"{_name}_{_table}"])


# ---- overviews ------------------------------------------------------------------------------
_ROUNDED = ("min", "max", "mean", "median", "std", "q1", "q3")


@query("dataset_overview", f"""WITH {_sql_types('events')}, u AS ({sql_unpivot("events", ["event_id", "user_id", "value"])}),
m AS (SELECT field, count(value) AS valid_count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, count(DISTINCT value) AS uniq,
 quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, bool_and(floor(value) = value) AS whole FROM u GROUP BY field),
s AS (SELECT *, CASE WHEN valid_count < 8 THEN 'insufficient_data' WHEN min = max THEN 'none' WHEN whole AND uniq <= 6 AND max <= 20 THEN 'unsupported' END AS idle FROM m),
o AS (SELECT field, count(*) AS n FROM u JOIN s USING (field) WHERE idle IS NULL AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) GROUP BY field)
SELECT f.ordinal, f.field, feature_type, total AS row_count, coalesce(total - valid_count, total - filled) AS missing_count,
 feature_type <> 'invalid' AND coalesce(total - valid_count, total - filled) > 0.3 * total AS high_missing, valid_count,
 {", ".join(f"{r('s.' + c)} AS {c}" for c in _ROUNDED)}, {r("q3 - q1")} AS iqr,
 CASE WHEN s.field IS NOT NULL THEN coalesce(idle, CASE WHEN o.n > 0 THEN 'detected' ELSE 'none' END) END AS outlier_status,
 CASE WHEN s.field IS NOT NULL THEN coalesce(o.n, 0) END AS outlier_count
FROM f LEFT JOIN s ON s.field = f.field AND feature_type = 'numerical' LEFT JOIN o ON o.field = s.field""")
def dataset_overview(spark, sf):
    return overview.dataset_overview(load(spark, sf, "events"))


query("dataset_overview_whole", ORACLES["dataset_overview"])(dataset_overview)


@query("overview_type_counts", f"WITH {_sql_types('orders')} SELECT feature_type, count(*) AS fields FROM f GROUP BY 1")
def overview_type_counts(spark, sf):
    return overview.type_counts(overview.dataset_overview(load(spark, sf, "orders"), _fields("orders")))


def _sql_2f(c: str) -> str:
    """``%.2f`` of the shortest decimal text, half up."""
    return f"printf('%.2f', cast(cast(cast({c} AS varchar) AS decimal(30, 8)) AS decimal(28, 2))::DOUBLE)"


@query("dataset_profile", f"""
WITH {_sql_types('orders')}, u AS ({sql_unpivot("orders", ["o_orderkey", "o_custkey", "o_totalprice"])}),
nums AS (SELECT field, count(*) AS n, count(value) AS valid, {r("min(value)")} AS min, {r("max(value)")} AS max, {r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS std FROM u GROUP BY field),
cat AS (SELECT field, v, count(*) AS c FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1, 2),
ck AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, v) AS k FROM cat),
cats AS (SELECT field, sum(c)::BIGINT AS valid, count(*) AS u, string_agg(concat(v, '=', c), '; ' ORDER BY k) FILTER (k <= 10) AS top, max(v) FILTER (k = 1) AS best, max(c) FILTER (k = 1) AS times FROM ck GROUP BY field)
SELECT field, feature_type, n AS count, valid AS valid_count, n - valid AS missing_count, nums.min, nums.max, nums.mean, std, NULL::BIGINT AS unique_count, NULL AS top_categories,
 concat(valid, ' 个有效值，', {_sql_2f("nums.min")}, ' 至 ', {_sql_2f("nums.max")}, '，均值 ', {_sql_2f("nums.mean")}, '，标准差 ', {_sql_2f("std")}) AS insight FROM nums JOIN f USING (field) WHERE feature_type = 'numerical'
UNION ALL SELECT field, feature_type, total, valid, total - valid, NULL, NULL, NULL, NULL, cats.u, top, concat(cats.u, ' 个类别，最多为 ', best, ' × ', times) FROM cats JOIN f USING (field) WHERE feature_type = 'categorical'
UNION ALL SELECT field, feature_type, total, total, 0, lo, hi, NULL, NULL, NULL, NULL, concat('时间范围 ', a, ' 到 ', b)
FROM f, (SELECT epoch_ms(min(o_orderdate))::DOUBLE AS lo, epoch_ms(max(o_orderdate))::DOUBLE AS hi, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM orders) WHERE feature_type = 'temporal'""")
def dataset_profile(spark, sf):
    return overview.dataset_profile(load(spark, sf, "orders"))


@query("dataset_anomalies", f"""
WITH {_sql_types('events')}, u AS (SELECT 'user_id' AS field, user_id::DOUBLE AS value, event_id FROM events UNION ALL SELECT 'value', value, event_id FROM events),
q AS (SELECT field, {r("quantile_cont(value, 0.25)")} AS q1, {r("quantile_cont(value, 0.75)")} AS q3, {r("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")} AS iqr, {r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS std FROM u GROUP BY field),
a AS (SELECT event_id AS _row_id, field, value, {r("(value - q.mean) / q.std")} AS z_score FROM u JOIN q USING (field) JOIN (SELECT field, feature_type FROM f) t USING (field) WHERE feature_type = 'numerical' AND (value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr))
SELECT *, CASE WHEN abs(z_score) > 3 THEN 'high' ELSE 'medium' END AS severity, concat('值 ', {_sql_2f("value")}, '，z = ', {_sql_2f("z_score")}) AS description FROM a""")
def dataset_anomalies(spark, sf):
    return overview.dataset_anomalies(load(spark, sf, "events").withColumnRenamed("event_id", "_row_id"))


@query("dataset_warnings", f"WITH {_sql_types('part')} SELECT count(*) FILTER (feature_type = 'invalid') AS unrecognised_fields FROM f")
def dataset_warnings(spark, sf):
    return overview.dataset_warnings(_counts(spark, sf, "part"))


_PRINTED = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "text"}
_PRINT_TEXT = " || ".join(f"length(coalesce({sql_text(c, kind)}, '')) || ':' || coalesce({sql_text(c, kind)}, '')" for c, kind in _PRINTED.items())


@query("fingerprint", f"WITH h AS (SELECT md5({_PRINT_TEXT}) AS h FROM orders) SELECT '{chr(1).join(_PRINTED)}' AS headers, count(*) AS rows, "
       + ", ".join(f"cast(sum(cast(('0x' || substr(h, {8 * k + 1}, 8)) AS bigint)) AS varchar) AS sum_{k}" for k in range(4)) + " FROM h")
def fingerprint(spark, sf):
    return profile.dataset_fingerprint(load(spark, sf, "orders"))


_DIRTY_PRINTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "price_text", "date_text"]
_DIRTY_TEXT = " || ".join(f"length(coalesce(cast({c} AS varchar), '')) || ':' || coalesce(cast({c} AS varchar), '')" for c in _DIRTY_PRINTED)


@query("fingerprint_dirty", f"WITH {DIRTY}, h AS (SELECT md5({_DIRTY_TEXT}) AS h FROM d) SELECT '{chr(1).join(_DIRTY_PRINTED)}' AS headers, count(*) AS rows, "
       + ", ".join(f"cast(sum(cast(('0x' || substr(h, {8 * k + 1}, 8)) AS bigint)) AS varchar) AS sum_{k}" for k in range(4)) + " FROM h")
def fingerprint_dirty(spark, sf):
    return profile.dataset_fingerprint(dirty_orders(spark, sf).select(*_DIRTY_PRINTED))
