"""Row classification and row accounting of a text table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrain.functions.text import normalize_cell
from cellgrain.operators.cells import number_of, text_of

# Cells that mark a row as a total line.
SUMMARY_LABELS = (
    "平均", "合计", "总计", "小计", "汇总", "累计", "最大值", "最小值",
    "标准差", "平均分",
)
ROW_TYPES = ("validData", "empty", "statusOnly", "summary", "invalid")


def _flag_sum(flags: Sequence[Column]) -> Column:
    return reduce(add, [f.cast("int") for f in flags])


def row_type(df: DataFrame, columns: Sequence[str], status_words: Sequence[str] = ()) -> Column:
    """'empty', 'summary', 'statusOnly' or 'validData' for each row."""
    filled, label, numeric, status = [], [], [], []
    for name in columns:
        t = normalize_cell(text_of(df, name))
        is_label = t.isin(*SUMMARY_LABELS)
        filled.append(t != "")
        label.append(is_label)
        numeric.append(~is_label & number_of(df, name).isNotNull())
        hit = F.lit(False)
        for word in status_words:
            hit = hit | F.contains(t, F.lit(word))
        status.append((t != "") & hit)
    n_filled, n_label = _flag_sum(filled), _flag_sum(label)
    n_other = n_filled - n_label
    # at least half of the other cells are numbers; also true when there are none
    mostly_numeric = _flag_sum(numeric) * 2 >= n_other
    return (
        F.when(n_filled == 0, "empty")
        .when((n_label > 0) & mostly_numeric, "summary")
        .when(F.lit(bool(status_words)) & (_flag_sum(status) == n_filled), "statusOnly")
        .otherwise("validData")
    )


def with_row_type(
    df: DataFrame, columns: Sequence[str] | None = None, status_words: Sequence[str] = (),
    out: str = "row_type",
) -> DataFrame:
    return df.withColumn(out, row_type(df, columns or df.columns, status_words))


def row_type_counts(df: DataFrame, columns: Sequence[str] | None = None, status_words: Sequence[str] = ()) -> DataFrame:
    typed = df.select(row_type(df, columns or df.columns, status_words).alias("row_type"))
    return typed.groupBy("row_type").agg(F.count(F.lit(1)).alias("rows"))


def keep_valid_rows(
    df: DataFrame, columns: Sequence[str] | None = None, status_words: Sequence[str] = ()
) -> DataFrame:
    """Valid rows; the whole table when not a single row is valid."""
    kind = row_type(df, columns or df.columns, status_words)
    any_valid = df.agg(F.bool_or(kind == "validData").alias("any")).scalar()
    return df.where((kind == "validData") | ~F.coalesce(any_valid, F.lit(False)))


def data_volume(
    df: DataFrame, columns: Sequence[str] | None = None, status_words: Sequence[str] = (),
    header_rows: int = 1,
) -> DataFrame:
    """One row of counters: physical = header + raw, parsed = sum of the row types."""
    typed = df.select(row_type(df, columns or df.columns, status_words).alias("t"))
    n = typed.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        *[F.count_if(F.col("t") == t).alias(t) for t in ROW_TYPES],
    )
    return n.select(
        (F.col("raw_rows") + header_rows).alias("physical_rows"),
        F.lit(header_rows).cast("bigint").alias("header_rows"),
        "raw_rows",
        F.col("raw_rows").alias("parsed_rows"),
        F.col("validData").alias("valid_rows"),
        F.col("empty").alias("empty_rows"),
        F.col("statusOnly").alias("status_rows"),
        F.col("summary").alias("summary_rows"),
        F.col("invalid").alias("invalid_rows"),
    )
