"""Even systematic sampling, the analysis size gate and record paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SIZE = 20
ALGORITHM = "systematic_even_v1"
# The whole numbers of sample_index stay below 2 ** 63.
MAX_SAMPLE = 2_000_000_000


def sample_index(i: Column, rows: int, size: int) -> Column:
    """round(i * (rows - 1) / (size - 1)), halves up, in whole numbers.

    Quotient and remainder of the step are taken apart, so that only numbers below rows + 2 * size ** 2 occur.
    """
    step = size - 1
    whole, rest = divmod(rows - 1, step)
    return (i * whole + F.call_function("div", i * (2 * rest) + step, F.lit(2 * step))).cast("bigint")


def systematic_indices(spark: SparkSession, rows: int, size: int) -> DataFrame:
    """Row positions of an even sample that includes the first and the last row."""
    if size <= 0 or rows <= 0:
        return spark.range(0).select(F.col("id").alias("_row_id"))
    if rows <= size:
        return spark.range(rows).select(F.col("id").alias("_row_id"))
    if size == 1:
        return spark.range(1).select(F.col("id").alias("_row_id"))
    return spark.range(size).select(sample_index(F.col("id"), rows, size).alias("_row_id"))


def is_sampled(row_id: Column, rows: int, size: int) -> Column:
    """Whether a row position belongs to the even sample, from the position alone.

    A position p is taken when the step nearest to it rounds back to p, so no join
    and no list of positions is needed at any sample size.
    """
    if size <= 0 or rows <= 0:
        return F.lit(False)
    if rows <= size:
        return F.lit(True)
    if size == 1:
        return row_id == 0
    if size > MAX_SAMPLE:
        raise ValueError(f"a sample may have {MAX_SAMPLE} rows at most")
    # an estimate whose error is a few parts in 10 ** 16 of a step number, so one of two neighbours is right
    near = F.floor(row_id.cast("double") * F.lit((size - 1) / (rows - 1)))
    out = F.lit(False)
    for i in (near, near + 1):
        out = out | ((i < size) & (sample_index(i, rows, size) == row_id))
    return out


def systematic_sample(
    df: DataFrame, size: int, row_id: str = "_row_id", rows: int | None = None
) -> DataFrame:
    """Even sample of a table that carries contiguous 0-based row ids."""
    rows = df.count() if rows is None else rows
    return df.where(is_sampled(F.col(row_id), rows, size))


@dataclass(frozen=True)
class SizeGate:
    """Limits of one analysis run; None switches a limit off (the default: full data)."""

    sample_above: int | None = None
    reject_above: int | None = None


def analysis_dataset(
    df: DataFrame, gate: SizeGate = SizeGate(), row_id: str = "_row_id", rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows to analyse, and one row describing the decision."""
    rows = df.count() if rows is None else rows
    sampled = gate.sample_above is not None and rows > gate.sample_above
    if rows == 0:
        status, data = "no_data", df
    elif gate.reject_above is not None and rows > gate.reject_above:
        status, data, sampled = "rejected", df.limit(0), False
    elif sampled:
        status, data = "ready_sampled", systematic_sample(df, gate.sample_above, row_id, rows)
    else:
        status, data = "ready_full", df
    got = {"no_data": 0, "rejected": 0, "ready_full": rows}.get(status, gate.sample_above)
    info = df.sparkSession.range(1).select(
        F.lit(status).alias("status"),
        F.lit(ALGORITHM if sampled else None).cast("string").alias("algorithm"),
        F.lit(rows).cast("bigint").alias("original_rows"),
        F.lit(got).cast("bigint").alias("analysed_rows"),
    )
    return data, info


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(size))).cast("bigint").alias("pages"),
    )


def page_after(df: DataFrame, key: str, after=None, size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows the row with key ``after`` (the first one for None), by a unique, non-null key.

    Deep pages cost no more than the first: a filter that reaches the scan, then ``size`` rows per task.
    """
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def page(df: DataFrame, order: list, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page (0-based) of an ordered result, for display; early pages only, as a task skips those before it.

    Deep pages of large results go by :func:`page_after`.
    """
    return df.orderBy(*order).offset(number * size).limit(size)
