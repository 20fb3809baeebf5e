"""Cell parsing, text normalisers, row classes, filters and the formula guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIRTY, dirty_orders, load, query, r, rounded, scratch, sql_date_ms, sql_empty, sql_num, sql_status,
)
from cellgrain.functions import dates, numbers, text
from cellgrain.operators import cells, filters, rows
from cellgrain.operators.filters import Condition
from cellgrain.plans import profile
from cellgrain.sources import delimited, export


@query("parse_number_dirty", f"""
WITH {DIRTY} SELECT o_orderkey, {sql_status("price_text")} AS status, {sql_num("price_text")} AS value FROM d""")
def parse_number_dirty(spark, sf):
    p = numbers.parse_number(F.col("price_text")).alias("p")
    return dirty_orders(spark, sf).select("o_orderkey", p).select("o_orderkey", "p.status", "p.value")


@query("parse_status_counts", f"""
WITH {DIRTY} SELECT {sql_status("price_text")} AS status, count(*) AS n FROM d GROUP BY 1""")
def parse_status_counts(spark, sf):
    status = numbers.number_status(F.col("price_text")).alias("status")
    return dirty_orders(spark, sf).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


@query("empty_like_counts", f"""
WITH {DIRTY} SELECT o_orderstatus, count(*) FILTER ({sql_empty("price_text")}) AS empty_cells,
  count(*) FILTER (NOT {sql_empty("price_text")}) AS filled_cells,
  count(*) FILTER (contains(coalesce(price_text, ''), '缺考')) AS status_cells,
  count(*) FILTER (regexp_full_match(coalesce(trim(price_text), ''), '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}')) AS date_cells
FROM d GROUP BY 1""")
def empty_like_counts(spark, sf):
    c = F.col("price_text")
    return dirty_orders(spark, sf).groupBy("o_orderstatus").agg(
        F.count_if(numbers.is_empty_like(c)).alias("empty_cells"),
        F.count_if(~numbers.is_empty_like(c)).alias("filled_cells"),
        F.count_if(numbers.has_status_word(c)).alias("status_cells"),
        F.count_if(numbers.is_date_shaped(c)).alias("date_cells"),
    )


@query("parse_date_dirty", f"""
WITH {DIRTY} SELECT o_orderkey, {sql_date_ms("date_text")} AS ms FROM d""")
def parse_date_dirty(spark, sf):
    return dirty_orders(spark, sf).select("o_orderkey", dates.parse_date_ms(F.col("date_text")).alias("ms"))


@query("temporal_cells", f"""
WITH {DIRTY}, s AS (SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN strftime(o_orderdate, '%Y.%-m.%-d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y')
  WHEN 2 THEN strftime(o_orderdate, '%Y年%-m月%-d日') ELSE date_text END AS cell FROM d)
SELECT o_orderkey, coalesce(epoch_ms(coalesce(try_strptime(cell, '%Y.%m.%d'), try_strptime(cell, '%m/%d/%Y'),
  try_strptime(cell, '%Y年%m月%d日'))), {sql_date_ms("cell")}) AS ms FROM s""")
def temporal_cells(spark, sf):
    cell = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy.M.d')
      WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy年M月d日')
      ELSE date_text END""")
    return dirty_orders(spark, sf).select("o_orderkey", dates.temporal_ms(cell).alias("ms"))


@query("standardize_types", f"""
WITH {DIRTY}
SELECT o_orderkey,
  CASE WHEN coalesce(trim(price_text), '') = '' THEN 'missing'
       WHEN {sql_num("price_text")} IS NULL THEN 'invalid' ELSE 'numerical' END AS price_tag,
  {sql_num("price_text")} AS price,
  CASE WHEN trim(date_text) = '' THEN 'missing' WHEN {sql_date_ms("date_text")} IS NULL THEN 'invalid'
       ELSE 'temporal' END AS date_tag,
  {sql_date_ms("date_text")} AS date_ms,
  'categorical' AS status_tag, o_orderstatus AS status_value FROM d""")
def standardize_types(spark, sf):
    std = cells.standardize(
        dirty_orders(spark, sf),
        {"price_text": "numerical", "date_text": "temporal", "o_orderstatus": "categorical"},
        ids=["o_orderkey"],
    )
    c = F.col
    return std.select(
        "o_orderkey", c("price_text.type").alias("price_tag"), c("price_text.num").alias("price"),
        c("date_text.type").alias("date_tag"), c("date_text.ms").alias("date_ms"),
        c("o_orderstatus.type").alias("status_tag"), c("o_orderstatus.str").alias("status_value"),
    )


@query("tagged_values", f"""
WITH {DIRTY} SELECT {sql_num("price_text")} AS value FROM d WHERE {sql_num("price_text")} IS NOT NULL""")
def tagged_values(spark, sf):
    std = cells.standardize(dirty_orders(spark, sf), {"price_text": "numerical"}, ids=["o_orderkey"])
    return cells.tagged_values(std, "price_text", "numerical")


@query("text_normalize", """
WITH s AS (SELECT c_custkey, concat('  ＡＢ： ', c_name, '　１２/', c_mktsegment, '  ') AS raw FROM customer),
h AS (SELECT c_custkey, translate(raw, 'ＡＢ：１２　', 'AB:12 ') AS half FROM s),
l AS (SELECT c_custkey, half, regexp_replace(trim(lower(half)), '\\s+', ' ', 'g') AS loose FROM h)
SELECT c_custkey, half, loose, regexp_replace(loose, '[\\s_\\-./:：,，。·;；]+', '', 'g') AS compact,
  regexp_replace(half, '\\D+', '', 'g') AS digits FROM l""")
def text_normalize(spark, sf):
    raw = F.concat(F.lit("  ＡＢ： "), "c_name", F.lit("　１２/"), "c_mktsegment", F.lit("  "))
    return load(spark, sf, "customer").select(
        "c_custkey", text.to_half_width(raw).alias("half"), text.loose(raw).alias("loose"),
        text.compact(raw).alias("compact"), text.digits_only(raw).alias("digits"),
    )


@query("similarity_pairs", f"""
SELECT p_partkey, {r("CASE WHEN p_name = p_type THEN 1.0 WHEN p_name = '' OR p_type = '' THEN 0.0 ELSE 1.0 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)) END", 6)} AS similarity FROM part""")
def similarity_pairs(spark, sf):
    s = text.similarity_ratio(F.lower("p_name"), F.lower("p_type")).alias("similarity")
    return rounded(load(spark, sf, "part").select("p_partkey", s), "similarity", digits=6)


@query("value_shapes", """
SELECT c_mktsegment, count(*) FILTER (regexp_full_match(c_name, '[0-9A-Za-z][0-9A-Za-z._\\-]{2,29}')) AS code,
  count(*) FILTER (regexp_full_match(cast(100000 + c_custkey AS varchar), '\\d{6,}')) AS long_digits,
  count(*) FILTER (regexp_full_match(cast(19000000 + c_custkey AS varchar), '\\d{8}')) AS compact_date,
  0::BIGINT AS chinese_name, 0::BIGINT AS class_label FROM customer GROUP BY 1""")
def value_shapes(spark, sf):
    n = F.count_if
    return load(spark, sf, "customer").groupBy("c_mktsegment").agg(
        n(text.is_code(F.col("c_name"))).alias("code"),
        n(text.is_long_digits((F.col("c_custkey") + 100000).cast("string"))).alias("long_digits"),
        n(text.is_compact_date((F.col("c_custkey") + 19000000).cast("string"))).alias("compact_date"),
        n(text.is_chinese_name(F.col("c_name"))).alias("chinese_name"),
        n(text.is_class_label(F.col("c_name"))).alias("class_label"),
    )


# ---- row classes ---------------------------------------------------------------
def _sheet(spark, sf):
    """Orders as a text sheet with blank lines, total lines and look-alike text lines."""
    return load(spark, sf, "orders").select(F.expr(
        """CASE WHEN o_orderkey % 10 IN (0, 3) THEN '合计' WHEN o_orderkey % 10 = 1 THEN ''
                WHEN o_orderkey % 10 = 2 THEN '统计学教材' ELSE o_orderpriority END AS label"""), F.expr(
        """CASE WHEN o_orderkey % 10 = 1 THEN ' ' WHEN o_orderkey % 10 = 3 THEN o_orderstatus
                ELSE cast(cast(floor(o_totalprice) AS int) AS string) END AS amount"""), F.expr(
        """CASE WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 10 = 3 THEN o_orderpriority
                ELSE cast(o_custkey AS string) END AS customer"""))


_SHEET = """s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 3) THEN '合计' WHEN o_orderkey % 10 = 1 THEN ''
   WHEN o_orderkey % 10 = 2 THEN '统计学教材' ELSE o_orderpriority END AS label,
 CASE WHEN o_orderkey % 10 = 1 THEN ' ' WHEN o_orderkey % 10 = 3 THEN o_orderstatus
   ELSE cast(cast(floor(o_totalprice) AS int) AS varchar) END AS amount,
 CASE WHEN o_orderkey % 10 = 1 THEN '' WHEN o_orderkey % 10 = 3 THEN o_orderpriority
   ELSE cast(o_custkey AS varchar) END AS customer FROM orders),
 k AS (SELECT CASE WHEN trim(label) = '' AND trim(amount) = '' AND customer = '' THEN 'empty'
   WHEN label = '合计' AND (CASE WHEN regexp_full_match(amount, '\\d+') THEN 1 ELSE 0 END
     + CASE WHEN regexp_full_match(customer, '\\d+') THEN 1 ELSE 0 END) * 2 >= 2 THEN 'summary'
   ELSE 'validData' END AS row_type, * FROM s)"""


@query("row_classes", f"WITH {_SHEET} SELECT row_type, count(*) AS rows FROM k GROUP BY 1")
def row_classes(spark, sf):
    return rows.row_type_counts(_sheet(spark, sf))


@query("valid_rows", f"WITH {_SHEET} SELECT label, amount, customer FROM k WHERE row_type = 'validData'")
def valid_rows(spark, sf):
    return rows.keep_valid_rows(_sheet(spark, sf))


@query("data_volume", f"""WITH {_SHEET} SELECT count(*) + 1 AS physical_rows, 1::BIGINT AS header_rows,
 count(*) AS raw_rows, count(*) AS parsed_rows, count(*) FILTER (row_type = 'validData') AS valid_rows,
 count(*) FILTER (row_type = 'empty') AS empty_rows, 0::BIGINT AS status_rows,
 count(*) FILTER (row_type = 'summary') AS summary_rows, 0::BIGINT AS invalid_rows FROM k""")
def data_volume(spark, sf):
    return rows.data_volume(_sheet(spark, sf))


# ---- filters --------------------------------------------------------------------
# ---- files ---------------------------------------------------------------------------
_WHOLE_CELL = f"trim(coalesce({{}}, ''), '{text.WHITESPACE}')"
_FILE_SQL = "SELECT cast(doc_id AS varchar) AS doc_id, {cells}, sha256({text}) AS text_sha256, cast(length({text}) AS INT) AS text_length FROM documents"
_FILE_CELLS = ", ".join(f"{_WHOLE_CELL.format(c)} AS {c}" for c in ("lang", "source"))


def _file_result(rows):
    return rows.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("text_length"))


@query("csv_file_cells", _FILE_SQL.format(cells=_FILE_CELLS, text=_WHOLE_CELL.format("text")))
def csv_file_cells(spark, sf):
    """All documents written as CSV files, line breaks inside quotes, and read back cell by cell."""
    path = scratch(spark, "csv")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    docs.repartition(8, "doc_id").write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="", nullValue="")
    return _file_result(delimited.read_csv(spark, path, multi_line=True).rows)


_FLAT = "regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g')"


@query("csv_split_file_cells", _FILE_SQL.format(cells=_FILE_CELLS, text=_WHOLE_CELL.format(_FLAT)))
def csv_split_file_cells(spark, sf):
    """Documents without line breaks, in files that several tasks may read."""
    path = scratch(spark, "csv")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    docs.write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="", nullValue="")
    return _file_result(delimited.read_csv(spark, path, multi_line=False).rows)


@query("tab_file_cells", _FILE_SQL.format(cells=_FILE_CELLS, text=_WHOLE_CELL.format(_FLAT)))
def tab_file_cells(spark, sf):
    """All documents as lines of tab-separated cells, each file with a header line."""
    path = scratch(spark, "tab")
    docs = load(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    docs.write.csv(path, header=True, sep="\t", quote="", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _file_result(delimited.read_lines(spark, path, delimiter="tab").rows)


@query("filter_numeric_ops", """
SELECT l_returnflag, count(*) AS rows, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 45 AND l_extendedprice >= 1000 AND l_discount < 0.09 AND l_tax IS NOT NULL
GROUP BY 1""")
def filter_numeric_ops(spark, sf):
    kept = filters.filter_rows(
        load(spark, sf, "lineitem"),
        [Condition("l_quantity", "gt", "10"), Condition("l_quantity", "lte", "45"),
         Condition("l_extendedprice", "gte", "1,000"), Condition("l_discount", "lt", "0.09"),
         Condition("l_tax", "isNotEmpty")],
        {"l_quantity", "l_extendedprice", "l_discount", "l_tax"},
    )
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("min_qty"),
        F.max("l_extendedprice").alias("max_price"),
    )


@query("filter_dirty_cells", f"""
WITH {DIRTY} SELECT o_orderkey, price_text FROM d WHERE {sql_num("price_text")} > 250000""")
def filter_dirty_cells(spark, sf):
    kept = filters.filter_rows(
        dirty_orders(spark, sf), [Condition("price_text", "gt", "250,000")], {"price_text"}
    )
    return kept.select("o_orderkey", "price_text")


@query("filter_text_ops", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(p_name, 'ring') AND NOT contains(p_brand, '#2') AND p_type <> '' AND p_type = 'ECONOMY'""")
def filter_text_ops(spark, sf):
    return filters.filter_rows(load(spark, sf, "part"), [
        Condition("p_name", "contains", " ring "), Condition("p_brand", "notContains", "#2"),
        Condition("p_type", "isNotEmpty"), Condition("p_type", "equals", "ECONOMY"),
    ]).select("p_partkey", "p_name", "p_brand")


@query("filter_not_contains_null", f"""
WITH {DIRTY} SELECT o_orderkey FROM d WHERE NOT contains(coalesce(price_text, ''), '1')""")
def filter_not_contains_null(spark, sf):
    return filters.filter_rows(
        dirty_orders(spark, sf), [Condition("price_text", "notContains", "1")]
    ).select("o_orderkey")


@query("filter_between", """
SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1000""")
def filter_between(spark, sf):
    old_form = filters.migrate_condition(Condition("p_size", "between", "10,20"))
    return filters.filter_rows(
        load(spark, sf, "part"), [old_form, Condition("p_retailprice", "between", low="900", high="1,000")],
        {"p_size", "p_retailprice"},
    ).select("p_partkey", "p_size", "p_retailprice")


@query("filter_summary", f"""
WITH n AS (SELECT count(*) AS original_count, count(*) FILTER (l_quantity >= 25 AND l_returnflag = 'R') AS filtered_count FROM lineitem)
SELECT *, {r("cast(original_count - filtered_count AS double) / original_count")} AS filter_ratio, 2::BIGINT AS active_conditions FROM n""")
def filter_summary(spark, sf):
    return rounded(filters.filter_summary(
        load(spark, sf, "lineitem"),
        [Condition("l_quantity", "gte", "25"), Condition("l_returnflag", "equals", "R")], {"l_quantity"},
    ), "filter_ratio")


@query("filter_empty_fallback", "SELECT o_orderkey FROM orders")
def filter_empty_fallback(spark, sf):
    return filters.filter_rows(
        load(spark, sf, "orders"), [Condition("o_totalprice", "lt", "-1")], {"o_totalprice"}, on_empty="keep"
    ).select("o_orderkey")


@query("field_values", f"""
WITH {DIRTY} SELECT o_orderkey, {sql_num("price_text")} AS value FROM d WHERE {sql_num("price_text")} IS NOT NULL""")
def field_values(spark, sf):
    return filters.field_values(dirty_orders(spark, sf), "price_text", "o_orderkey")


@query("extraction_counts", f"""
WITH {DIRTY} SELECT 'price_text' AS field, count(*) AS total_rows, count({sql_num("price_text")}) AS valid_count,
 count(*) - count({sql_num("price_text")}) AS invalid_count FROM d""")
def extraction_counts(spark, sf):
    return filters.extraction_counts(dirty_orders(spark, sf), "price_text")


@query("numeric_filterable", """
SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS field,
 unnest([NOT (SELECT count(DISTINCT c_custkey) > 0.8 * count(*) AND count(*) FILTER (c_custkey >= 100000) > 0.5 * count(*) FROM customer),
  false, true, false]) AS numeric_filterable""")
def numeric_filterable(spark, sf):
    from cellgrain.plans import legacy

    counts = profile.column_counts(load(spark, sf, "customer"), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return filters.numeric_filterable(legacy.classify_fields(counts))


# ---- sinks and ragged lines -------------------------------------------------------
_GUARD_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat('=', o_orderstatus) WHEN 1 THEN concat(' +', o_orderstatus)
  WHEN 2 THEN concat('@', o_orderstatus) WHEN 3 THEN concat('-', o_orderstatus)
  WHEN 4 THEN concat('-', cast(o_custkey AS {s})) ELSE o_orderpriority END"""


@query("csv_formula_guard", f"""
WITH g AS (SELECT o_orderkey, {_GUARD_TEXT.format(s="varchar")} AS cell FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(trim(cell), '^[=+@]') OR (trim(cell) LIKE '-%' AND NOT regexp_full_match(trim(cell), '-\\d+'))
 THEN concat('''', cell) ELSE cell END AS cell FROM g""")
def csv_formula_guard(spark, sf):
    cell = F.expr(_GUARD_TEXT.format(s="string"))
    return export.guarded(load(spark, sf, "orders").select("o_orderkey", cell.alias("cell")))


@query("csv_lines", '''
SELECT concat(cast(p_partkey AS varchar), ',', '"', p_name, ', ""', p_brand, '""",', cast(p_size AS varchar)) AS value FROM part''')
def csv_lines(spark, sf):
    named = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("title")
    return export.csv_lines(load(spark, sf, "part").select("p_partkey", named, "p_size"))


_RAGGED = """CASE p_partkey % 5 WHEN 0 THEN concat_ws(',', p_name, p_brand, p_type, p_brand)
  WHEN 1 THEN concat_ws(',', p_name, p_brand) WHEN 2 THEN concat_ws(',', p_name, p_brand, p_type, '', '')
  WHEN 3 THEN concat('"', p_name, ',', p_brand, '",', p_type, ',x') ELSE concat('"', p_name, ',', p_brand, ',', p_type) END"""


@query("ragged_rows", """
SELECT CASE p_partkey % 5 WHEN 0 THEN 'too_wide' WHEN 1 THEN 'short' WHEN 4 THEN 'open_quote' ELSE 'ok' END AS route,
 count(*) AS records FROM part GROUP BY 1""")
def ragged_rows(spark, sf):
    lines = load(spark, sf, "part").select(F.expr(_RAGGED).alias("value"))
    return delimited.route_records(lines, ["name", "brand", "type"]).counts


@query("ragged_good_rows", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN concat(p_name, ',', p_brand) ELSE p_name END AS name,
 CASE WHEN p_partkey % 5 = 3 THEN p_type ELSE p_brand END AS brand,
 CASE p_partkey % 5 WHEN 1 THEN '' WHEN 2 THEN p_type ELSE 'x' END AS type FROM part WHERE p_partkey % 5 IN (1, 2, 3)""")
def ragged_good_rows(spark, sf):
    lines = load(spark, sf, "part").select("p_partkey", F.expr(_RAGGED).alias("value"))
    return delimited.route_records(lines, ["name", "brand", "type"]).rows


@query("csv_document_cells", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 3 END AS cells, lang,
 length(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f\\v]', '', 'g')) AS length, md5(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f\\v]', '', 'g')) AS digest
FROM documents""")
def csv_document_cells(spark, sf):
    """Whole texts as quoted cells with commas, doubled quotes and line breaks, some records with a surplus cell."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), quoted, "lang", F.when(F.col("doc_id") % 7 == 0, F.lit('"x ""y"", z"')))
    got = load(spark, sf, "documents").select("doc_id", delimited.split_cells(line).alias("c"))
    plain = F.regexp_replace(F.col("c")[1], r"[ \t\r\n\f\x0B]", "")
    return got.select(
        F.col("c")[0].cast("bigint").alias("doc_id"), F.size("c").alias("cells"), F.col("c")[2].alias("lang"),
        F.length(plain).cast("bigint").alias("length"), F.md5(plain).alias("digest"),
    )


@query("spaced_lines", """
SELECT c_custkey, c_name AS name, c_mktsegment AS segment, cast(c_nationkey AS varchar) AS nation FROM customer""")
def spaced_lines(spark, sf):
    line = F.concat("c_name", F.lit("   "), "c_mktsegment", F.lit(" \t "), F.col("c_nationkey").cast("string"))
    lines = load(spark, sf, "customer").select("c_custkey", line.alias("value"))
    return delimited.route_records(lines, ["name", "segment", "nation"], "multi-space").rows


@query("normalized_cells", f"""
WITH {DIRTY} SELECT cast(o_orderkey AS varchar) AS o_orderkey, coalesce(trim(price_text), '') AS price_text, trim(date_text) AS date_text FROM d""")
def normalized_cells(spark, sf):
    return delimited.normalize_cells(dirty_orders(spark, sf).select("o_orderkey", "price_text", "date_text"))


