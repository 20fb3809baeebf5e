"""Grouped statistics of one metric over one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrain.functions.text import normalize_cell
from cellgrain.operators import ordering
from cellgrain.operators.cells import number_of, text_of

# Fixed value: the group of blank dimension cells.
BLANK_GROUP = "(空值)"
SORT_FIELDS = ("count", "mean", "median", "min", "max", "q25", "q75")
TOP_GROUPS = 20


def group_by_dimension(
    df: DataFrame, metric: str, dimension: str, *, method: str = "exact", rows: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """count, mean, quartiles and range of the metric per dimension value, best mean first.

    Blank dimension cells form their own group; a placeholder such as '-' is an
    ordinary value.  Rows without a number are dropped, and so are groups left empty.
    """
    key = normalize_cell(text_of(df, dimension))
    cells = df.select(
        F.when(key == "", F.lit(BLANK_GROUP)).otherwise(key).alias("dimension_value"),
        number_of(df, metric).alias("value"),
    ).where("value IS NOT NULL")
    if method == "exact":
        rows = ordering.count_rows(df, rows)
    got = ordering.quantiles(
        cells, ["dimension_value"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75},
        aggs=[
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        ],
        method=method, rows=rows,
    ).select("dimension_value", *SORT_FIELDS)
    return got.orderBy(F.desc("mean")) if ordered else got


def sort_groups(stats: DataFrame, by: str = "mean", ascending: bool = False) -> DataFrame:
    """Order groups by one statistic; ties by name in Chinese collation order."""
    if by not in SORT_FIELDS:
        raise ValueError(f"cannot sort groups by {by!r}")
    first = F.col(by).asc() if ascending else F.col(by).desc()
    return stats.orderBy(first, F.collate(F.col("dimension_value"), "zh"))


def top_groups(stats: DataFrame, n: int = TOP_GROUPS, by: str = "mean", ascending: bool = False) -> DataFrame:
    """The first n groups: Spark keeps n rows per task and merges those."""
    return sort_groups(stats, by, ascending).limit(n)
