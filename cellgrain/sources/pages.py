"""A sorted copy of a table with a directory of its files, so that any page or row position reads only the files that hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.operators.sampling import PAGE_SIZE, is_sampled, sample_index

_POSITION = "_row_id"


def write_pages(df: DataFrame, order: Sequence[Column | str], path: str, parts: int | None = None) -> None:
    """Sort by ``order`` and write to ``path``: the rows in a folder per range, and a directory with a row per range.

    ``order`` should tell all rows apart; rows that tie in it keep whatever places the sort gives them, and
    keep them, as places are written.  ``parts`` is the number of ranges (the session's shuffle partitions if None).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    placed.withColumn("_at", at).select(
        "*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")
    ).drop("_at").write.partitionBy("_part").parquet(f"{path}/rows")
    sizes = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    # a row per range
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes.withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/directory")


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/directory")


def _rows(spark: SparkSession, path: str, ranges: Sequence[int] | None) -> DataFrame:
    """Rows of the named ranges (all if None) with their positions in the whole table."""
    rows = spark.read.parquet(f"{path}/rows")
    if ranges is not None:
        rows = rows.where(F.col("_part").isin(*ranges))
    first = F.broadcast(_ranges(spark, path).select("_part", "first_row"))
    return rows.join(first, "_part").withColumn(_POSITION, F.col("first_row") + F.col("_place")).drop("_part", "_place", "first_row")


def read_page(spark: SparkSession, path: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) in order, with the positions of its rows as ``_row_id``."""
    low, high = number * size, (number + 1) * size
    hit = _ranges(spark, path).where((F.col("first_row") < high) & (F.col("first_row") + F.col("rows") > low))
    ranges = [r["_part"] for r in hit.select("_part").collect()]  # at most ``size``
    return _rows(spark, path, ranges or [-1]).where(F.col(_POSITION).between(low, high - 1)).orderBy(_POSITION)


def row_count(spark: SparkSession, path: str) -> int:
    """From the directory alone."""
    return _ranges(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def read_sample(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The even sample of ``size`` rows, first and last among them; ranges without a sampled position are not read."""
    rows = row_count(spark, path)
    if rows > size > 1:
        # the first sampled position at or after the range's first row
        step = F.ceil(F.col("first_row") * F.lit((size - 1) / (rows - 1)) - 1)
        near = F.least(*(F.when(p >= F.col("first_row"), p) for p in (sample_index(F.greatest(step + k, F.lit(0)), rows, size) for k in range(4))))
        hit = _ranges(spark, path).where(near < F.col("first_row") + F.col("rows"))
        ranges = [r["_part"] for r in hit.select("_part").collect()]  # a number per range
    else:
        ranges = None
    return _rows(spark, path, ranges).where(is_sampled(F.col(_POSITION), rows, size))
