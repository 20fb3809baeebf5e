"""Column profiles: one row per column, from two scans that move no cell.

One scan sums what can be told of each cell by itself: cells are put one below the other inside their task and summed per
column there, so a row per task and column is shuffled.  The other counts distinct cells by 128-bit hashes, which
tasks merge before they leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.functions import dates, numbers, text
from cellgrain.operators.cells import KIND_TEXT, KIND_TIME, kind_of, number_of, text_of
from cellgrain.plans.rules import once

LONG_TEXT = 50
# Texts that count as missing.
MISSING = ("", "null", "undefined")


def _cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(ordinal, field, kind, cell, num)``: normalised text and number of every cell; numbers of typed columns as they are."""
    return df.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(k).alias("ordinal"), F.lit(f).alias("field"),
                F.lit(kind_of(df, f)).alias("kind"),
                text.normalize_cell(text_of(df, f)).alias("cell"),
                number_of(df, f).alias("num"),
            )
            for k, f in enumerate(fields)
        ]))
    )


def distinct_cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(ordinal, n_distinct)`` of the normalised cells, blanks included.  What is shuffled is a hash of each distinct cell."""
    hashed = df.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("ordinal"), F.xxhash64(c).alias("_a"), F.xxhash64(F.lit(1), c).alias("_b"))
        for k, c in enumerate(text.normalize_cell(text_of(df, f)) for f in fields)
    ])))
    return hashed.distinct().groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_distinct"))


def column_counts(df: DataFrame, fields: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """All counters a schema rule may ask for, one row per column.

    ``approx=True`` estimates distinct counts with a sketch in the same scan and shuffles no hashes.
    """
    fields = list(fields or df.columns)
    cells = _cells(df, fields).withColumn("len", F.length("cell").cast("bigint"))
    cell, num, length = F.col("cell"), F.col("num"), F.col("len")
    filled = cell != ""
    whole = F.floor(num).cast("double") == num
    all_rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    small = whole & (num >= 1) & (num <= all_rows * 2)
    # typed columns have no words
    textual, time_kind = F.col("kind") == KIND_TEXT, F.col("kind") == KIND_TIME
    digits = cell.rlike(text.RE_ALL_DIGITS)

    def total(test: Column) -> Column:
        return F.count_if(test)

    def words(test: Column) -> Column:
        return F.count_if(F.when(textual & filled, test).otherwise(F.lit(False)))

    counted = cells.withColumn("_digits", digits).groupBy("ordinal", "field", "kind").agg(
        F.count(F.lit(1)).alias("total"),
        total(filled).alias("filled"),
        *[total(cell == m).alias(f"_missing{i}") for i, m in enumerate(MISSING)],
        F.count("num").alias("numeric"),
        total(numbers.is_empty_like(cell)).alias("empty_like"),
        total(whole).alias("integer"),
        total(small).alias("small_integer"),
        total(num.between(0, 1000)).alias("score_range"),
        total(F.col("_digits") & (length >= 6)).alias("long_digits"),
        total(F.col("_digits")).alias("digit_cells"),
        F.coalesce(F.sum(F.when(F.col("_digits"), length)), F.lit(0)).cast("bigint").alias("digit_length"),
        F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("length"),
        total(length >= LONG_TEXT).alias("long_text"),
        total(filled & (time_kind | dates.is_temporal(cell))).alias("temporal"),
        words(cell.rlike(text.RE_CHINESE_NAME)).alias("chinese_name"),
        words(cell.rlike(text.RE_CLASS_LABEL)).alias("class_label"),
        total(cell.rlike(text.RE_CODE)).alias("code"),
        total(time_kind & filled | cell.rlike(text.RE_COMPACT_DATE)).alias("compact_date"),
        F.min("num").alias("min"), F.max("num").alias("max"), F.avg("num").alias("mean"),
        *([F.approx_count_distinct(cell).alias("n_distinct")] if approx else []),
    )
    if not approx:
        counted = counted.join(F.broadcast(distinct_cells(df, fields)), "ordinal")  # a row per column
    present = [F.when(F.col(f"_missing{i}") > 0, 1).otherwise(0) for i in range(len(MISSING))]
    unique = F.col("n_distinct")
    return counted.select(
        "ordinal", "field", "kind", "total", "filled", unique.alias("unique_all"),
        F.greatest(unique - present[0], F.lit(0)).alias("unique_filled"),
        sum((F.col(f"_missing{i}") for i in range(len(MISSING))), F.lit(0).cast("bigint")).alias("missing"),
        F.greatest(unique - sum(present, F.lit(0)), F.lit(0)).alias("unique_present"),
        "numeric", "empty_like", "integer", "small_integer", "score_range", "long_digits", "digit_cells", "digit_length",
        "length", "long_text", "temporal", "chinese_name", "class_label", "code", "compact_date", "min", "max", "mean",
    )


def share(part: str | Column, whole: str | Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def feature_types(
    counts: DataFrame, *, min_numeric: float = 0.7, min_unique: float = 0.9,
    min_id_length: float = 6, max_temporal_fail: int = 3, max_category_ratio: float = 0.5,
    max_category_count: int = 50, min_text_length: float = LONG_TEXT,
) -> DataFrame:
    """Feature type of each column with confidence and reason; ratios over non-blank cells."""
    c = F.col
    unique = share("unique_filled", "filled")
    digit_share = share("digit_cells", "filled")
    digit_length = share("digit_length", "digit_cells")
    numeric = share("numeric", "filled")
    fails = c("filled") - c("temporal")
    temporal = share("temporal", "filled")
    mean_length = share("length", "filled")
    long_share = share("long_text", "filled")
    low = F.lower("field")
    # Header words of identifiers.
    named = F.lit(False)
    for word in ("id", "code", "no", "num", "编号", "工号", "身份证号"):
        named = named | F.contains(low, F.lit(word))

    def kind(name: str, confidence: Column, reason: str) -> Column:
        return F.struct(
            F.lit(name).alias("type"), confidence.cast("double").alias("confidence"),
            F.lit(reason).alias("reason"),
        )

    one = F.lit(1.0)
    found = (
        F.when(c("filled") == 0, kind("invalid", one, "all_blank"))
        .when(c("kind") == "time", kind("temporal", F.lit(0.95), "typed_column"))
        .when(c("kind") == "flag", kind("categorical", F.lit(0.9), "typed_column"))
        .when(
            (unique >= min_unique) & (digit_share >= 0.8) & (digit_length >= min_id_length),
            kind("identifier", F.lit(0.95), "unique_long_digits"),
        )
        .when((unique >= min_unique) & named, kind("identifier", F.lit(0.85), "identifier_name"))
        .when(numeric >= min_numeric, kind("numerical", F.least(F.lit(0.99), numeric), "numeric_share"))
        .when(
            (fails <= max_temporal_fail) & (temporal >= 0.8) & (c("temporal") >= 3),
            kind("temporal", F.least(F.lit(0.95), temporal), "date_share"),
        )
        .when(
            (mean_length >= min_text_length) & (long_share >= 0.5),
            kind("text", F.lit(0.85), "long_text"),
        )
        .when(
            (c("unique_filled") <= max_category_count) & (unique <= max_category_ratio),
            kind("categorical", F.least(F.lit(0.9), one - unique), "few_values"),
        )
        .otherwise(kind("invalid", F.lit(0.5), "unrecognised"))
    )
    return once(counts, _t=found).select(
        "ordinal", "field", c("_t.type").alias("feature_type"),
        c("_t.confidence").alias("confidence"), c("_t.reason").alias("reason"),
    )


def structure_features(counts: DataFrame) -> DataFrame:
    """Shape of each column; ratios over all cells, blanks included."""
    return counts.select(
        "ordinal", "field", "kind",
        share("numeric", "total").alias("numeric_ratio"),
        share("integer", "numeric").alias("integer_ratio"),
        share("unique_all", "total").alias("unique_ratio"),
        share("long_digits", "total").alias("long_digit_ratio"),
        share("length", "total").alias("avg_length"),
        share("small_integer", "numeric").alias("small_integer_ratio"),
        "min", "max", "mean",
    )


def kept_small(frame: DataFrame) -> DataFrame:
    """A frame of one row per column, brought to the driver once and used as local data.

    Later steps then start from these rows instead of scanning the table again.
    """
    return frame.sparkSession.createDataFrame(frame.collect(), frame.schema)


def content_columns() -> list[Column]:
    """Ratios, range and value pattern as expressions over column counts."""
    numeric = share("numeric", "total")
    pattern = (
        F.when(F.col("total") == 0, "unknown")
        .when(share("chinese_name", "total") > 0.5, "chineseName")
        .when(share("class_label", "total") > 0.3, "classLabel")
        .when(share("long_digits", "total") > 0.5, "longNumber")
        .when(
            numeric > 0.5,
            F.when(share("small_integer", "numeric") > 0.7, "rankLike")
            .when(share("score_range", "numeric") > 0.7, "scoreLike")
            .otherwise("mixed"),
        )
        .otherwise("unknown")
    )
    return [
        numeric.alias("numeric_ratio"),
        share("integer", "numeric").alias("integer_ratio"),
        share(F.col("numeric") - F.col("integer"), "numeric").alias("decimal_ratio"),
        share("unique_all", "total").alias("unique_ratio"),
        *map(F.col, ("min", "max", "mean")),
        share("length", "total").alias("avg_length"),
        pattern.alias("value_pattern"),
    ]


def content_features(counts: DataFrame) -> DataFrame:
    """Ratios plus the value pattern that older field metadata uses."""
    return counts.select("ordinal", "field", *content_columns())


def value_status_columns() -> list[Column]:
    rest = F.col("total") - F.col("numeric")
    return [
        F.col("numeric").alias("valid_count"),
        F.col("empty_like").alias("empty_count"),
        (rest - F.col("empty_like")).alias("invalid_count"),
        rest.alias("text_count"),
    ]


def value_status_counts(counts: DataFrame) -> DataFrame:
    """Valid, empty and invalid cells per column; text = empty + invalid."""
    return counts.select("ordinal", "field", *value_status_columns())


def field_statistics(counts: DataFrame) -> DataFrame:
    return counts.select(
        "ordinal", "field",
        F.col("missing").alias("missing_count"),
        F.col("unique_present").alias("unique_count"),
    )


def sample_values(
    df: DataFrame, fields: Sequence[str], row_id: str = "_row_id", n: int = 3
) -> DataFrame:
    """The first n present cells of each column in row order, as one array per column.

    Filtering on the rank makes Spark keep n rows per column and task before the shuffle.
    """
    cells = df.select(
        F.col(row_id).alias("_id"),
        F.inline(F.array(*[
            F.struct(
                F.lit(k).alias("ordinal"), F.lit(f).alias("field"),
                text.normalize_cell(text_of(df, f)).alias("cell"),
            )
            for k, f in enumerate(fields)
        ])),
    ).where(~F.col("cell").isin(*MISSING))
    order = W.partitionBy("ordinal", "field").orderBy("_id")
    first = cells.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    return first.groupBy("ordinal", "field").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", "cell"))), lambda s: s["cell"]
        ).alias("sample_values")
    )


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Header text, row count and an order-free content hash over every row.

    The row hash is an md5 over the cells' texts with their lengths, summed in four 32-bit slices. Sums
    tell apart tables that differ in repeated rows.
    """
    names = df.columns
    cells = [F.coalesce(text_of(df, c), F.lit("")) for c in names]
    h = F.md5(F.concat_ws("", *[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cells]))
    slices = df.select(*[F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"s{k}") for k in range(4)])
    # halves of a slice are summed as whole numbers, which 2 ** 47 rows do not exceed, and put together once
    halves = [F.sum(half).alias(f"{name}{k}") for k in range(4) for name, half in (("hi", F.shiftright(f"s{k}", 16)), ("lo", F.col(f"s{k}").bitwiseAND(0xFFFF)))]

    def whole(k: int) -> Column:
        hi, lo = (F.coalesce(f"{name}{k}", F.lit(0)).cast("decimal(20,0)") for name in ("hi", "lo"))
        return (hi * 65536 + lo).cast("decimal(38,0)").cast("string").alias(f"sum_{k}")

    return slices.agg(F.count(F.lit(1)).alias("rows"), *halves).select(
        F.lit("\x01".join(names)).alias("headers"), "rows", *[whole(k) for k in range(4)]
    )
