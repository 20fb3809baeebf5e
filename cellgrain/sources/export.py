"""CSV sinks that spreadsheets can open safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.functions import numbers
from cellgrain.functions.text import trimmed
from cellgrain.operators.cells import ref, text_of

# Headers of the group-statistics sheet.
GROUP_HEADERS = (
    ("dimension_value", "维度值"), ("count", "数量"), ("mean", "均值"), ("median", "中位数"),
    ("min", "最小值"), ("max", "最大值"), ("q25", "Q25"), ("q75", "Q75"),
)
# Keys of the summary sheet.
STAT_KEYS = (
    ("valid_count", "有效数值"), ("invalid_count", "无效/空值"), ("count", "总数"), ("mean", "均值"),
    ("median", "中位数"), ("min", "最小值"), ("max", "最大值"), ("q25", "Q25"), ("q75", "Q75"),
    ("q90", "Q90"), ("q95", "Q95"),
)
POSITION_KEYS = (
    ("total", "总记录数"), ("higher_count", "高于该值记录数"), ("equal_count", "等于该值记录数"),
    ("lower_count", "低于该值记录数"), ("best_rank", "相对位置区间起点"),
    ("worst_rank", "相对位置区间终点"), ("estimated_rank", "估算相对位置"), ("percentile", "百分位"),
)
DIRECTION_TEXT = (
    ("higher-is-better", "越高越好"), ("lower-is-better", "越低越好"),
    ("neutral", "中性（无优劣方向）"), ("unspecified", "未指定方向"),
)
NO_VERDICT = "当前字段方向未指定，仅展示统计分布，不进行优劣评价。"


def guard_cell(c: Column) -> Column:
    """Put ' before text a spreadsheet would run as a formula; real negative numbers stay."""
    t = trimmed(c)
    first = F.substring(t, 1, 1)
    risky = first.isin("=", "+", "@") | ((first == "-") & numbers.number(t).isNull())
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def guarded(df: DataFrame) -> DataFrame:
    """The formula guard on every text column."""
    return df.select(*[
        guard_cell(ref(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else ref(f.name)
        for f in df.schema.fields
    ])


def csv_cell(c: Column) -> Column:
    """Guard, then quote a cell that holds a comma, a quote or a line break."""
    safe = guard_cell(F.coalesce(c, F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[,"\r\n]'), quoted).otherwise(safe)


def csv_lines(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One text line per row, numbers unguarded."""
    cells = []
    for name in columns or df.columns:
        if isinstance(df.schema[name].dataType, T.StringType):
            cells.append(csv_cell(ref(name)))
        else:
            cells.append(F.coalesce(text_of(df, name), F.lit("")))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, bom: bool = False, mode: str = "errorifexists"
) -> None:
    """Write a CSV folder with CRLF line ends, all rows, in parallel.

    Without ``bom`` every part file carries the header.  With it the first part is a
    BOM plus the header alone, so the parts joined in name order form one file.
    """
    names = list(columns or df.columns)
    picked = df.select(*[ref(c) for c in names])
    if not bom:
        # the writer quotes; an empty text is written as nothing, not as ""
        guarded(picked).write.mode(mode).csv(
            path, header=True, quote='"', escape='"', emptyValue="", lineSep="\r\n",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        return
    spark = df.sparkSession
    head = spark.range(1, numPartitions=1).select(
        F.concat(F.lit("\ufeff"), F.concat_ws(",", *[csv_cell(F.lit(c)) for c in names])).alias("value")
    )
    head.unionByName(csv_lines(picked, names)).write.mode(mode).text(path, lineSep="\r\n")


def group_sheet(stats: DataFrame) -> DataFrame:
    """Group statistics under their sheet headers."""
    return stats.select(*[F.col(name).alias(title) for name, title in GROUP_HEADERS])


def summary_sheet(metrics: DataFrame, sampling: DataFrame | None = None) -> DataFrame:
    """``(metric, section, ord, key, value)`` of computed metrics, ready to write.

    Takes the result of ``compute_metrics``.  Position rows are left out for metrics
    without a direction.  ``sampling`` is the info row of ``analysis_dataset``.
    """
    c = F.col
    directed = c("direction").isin("higher-is-better", "lower-is-better")
    text = F.lit(None).cast("string")
    for name, title in DIRECTION_TEXT:
        text = F.when(c("direction") == name, F.lit(title)).otherwise(text)

    def entry(section: str, order: int, key: str, value: Column, test: Column | None = None) -> Column:
        made = F.struct(
            F.lit(section).alias("section"), F.lit(order).alias("ord"), F.lit(key).alias("key"),
            value.cast("string").alias("value"),
        )
        return made if test is None else F.when(test, made)

    frame = metrics.withColumn("count", c("valid_count"))
    has_stats = c("valid_count") > 0
    placed = c("total").isNotNull() & directed
    side = F.when(
        c("is_out_of_range"),
        F.when(c("out_of_range_direction") == "below", "低于数据范围").otherwise("高于数据范围"),
    ).otherwise("否")
    entries = [entry("field", 0, "指标字段", c("metric"))]
    entries += [
        entry("stats", i, title, text_of(frame, name), has_stats)
        for i, (name, title) in enumerate(STAT_KEYS)
    ]
    entries += [
        entry("position", i, title, text_of(frame, name), placed)
        for i, (name, title) in enumerate(POSITION_KEYS)
    ]
    n = len(POSITION_KEYS)
    entries += [
        entry("position", n, "该值是否存在于数据中", F.when(c("exists_in_data"), "是").otherwise("否"), placed),
        entry("position", n + 1, "是否超出数据范围", side, placed),
        entry("interpretation", 0, "指标名", c("metric")),
        entry("interpretation", 1, "显示名", c("display_name")),
        entry("interpretation", 2, "方向", text),
        entry("interpretation", 3, "总行数", c("total_rows")),
        entry("interpretation", 4, "有效值数量", c("valid_count")),
        entry("interpretation", 5, "无效值数量", c("invalid_count")),
        entry("interpretation", 6, "说明", F.lit(NO_VERDICT), ~directed),
    ]
    sheet = frame.select(
        "metric", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    )
    if sampling is not None:
        info = sampling.where("status = 'ready_sampled'").select(F.inline(F.array(
            entry("sampling", 0, "抽样算法", c("algorithm")),
            entry("sampling", 1, "原始行数", c("original_rows")),
            entry("sampling", 2, "抽样后行数", c("analysed_rows")),
        )))
        sheet = sheet.unionByName(info.select(F.lit(None).cast("string").alias("metric"), "*"))
    return sheet
