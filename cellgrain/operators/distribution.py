"""Histogram, quartile segments, empirical distribution and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrain.functions.numbers import half_up
from cellgrain.operators import ordering
from cellgrain.operators.cells import number_of

# Full marks by header word, in order of precedence.
AXIS_MAX_BY_WORD = (
    ("总分", 750), ("总分合计", 750),
    ("语文数学两科之和", 300), ("语数之和", 300), ("两科之和", 300),
    ("语文或数学单科最高", 150), ("单科最高", 150),
    ("外语", 150), ("英语", 150),
    ("首选", 100), ("再选", 100),
)


def _label(v: Column, precision: Column) -> Column:
    """A bin edge with a fixed number of decimals."""
    out = F.floor(v + F.lit(0.5)).cast("string")
    for p in range(1, 9):
        out = F.when(precision == p, F.format_string(f"%.{p}f", v)).otherwise(out)
    return out


def histogram(df: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed; empty bins are kept.

    A constant field gives a single bin, a field without numbers gives none.
    """
    values = df.select(number_of(df, field).alias("value")).where("value IS NOT NULL")
    # one row with the range; a scalar subquery, so no join is planned
    limits = values.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("b"))
    binned = (
        values.withColumn("_b", limits.scalar())
        .withColumn("_w", (F.col("_b.hi") - F.col("_b.lo")) / F.lit(float(bins)))
        .select(
            F.when(F.col("_w") == 0, F.lit(0)).otherwise(
                F.greatest(
                    F.lit(0),
                    F.least(
                        F.lit(bins - 1),
                        F.floor(F.try_divide(F.col("value") - F.col("_b.lo"), F.col("_w"))).cast("int"),
                    ),
                )
            ).alias("bin")
        )
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    )
    frame = (
        limits.where("b.lo IS NOT NULL")
        .withColumn("width", (F.col("b.hi") - F.col("b.lo")) / F.lit(float(bins)))
        .select(
            "b", "width",
            F.explode(
                F.when(F.col("width") == 0, F.array(F.lit(0))).otherwise(
                    F.sequence(F.lit(0), F.lit(bins - 1))
                )
            ).alias("bin"),
        )
    )
    start = F.col("b.lo") + F.col("bin") * F.col("width")
    ref_width = F.col("width") / F.lit(10.0)
    precision = F.when(ref_width >= 1, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(8), F.ceil(-F.log10(ref_width)).cast("int")))
    )
    constant = F.col("width") == 0
    return frame.join(F.broadcast(binned), "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        start.alias("start"),
        F.when(constant, F.col("b.hi")).otherwise(start + F.col("width")).alias("end"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.when(constant, F.col("b.lo").cast("string")).otherwise(
            F.concat(_label(start, precision), F.lit("~"), _label(start + F.col("width"), precision))
        ).alias("label"),
    )


def locate_bin(hist: DataFrame, x: float) -> DataFrame:
    """The bin of a value (half-open, last one closed), or the side it falls off."""
    v = F.lit(float(x))
    lo, hi = F.col("_lo"), F.col("_hi")
    edges = hist.agg(
        F.min("start").alias("_lo"), F.max("end").alias("_hi"), F.max("bin").alias("_last"),
        F.max(F.when((v >= F.col("start")) & (v < F.col("end")), F.col("bin"))).alias("_open"),
    )
    return edges.select(
        v.alias("x"),
        F.coalesce("_open", F.when(v == hi, F.col("_last"))).alias("bin"),
        (v < lo).alias("below_range"), (v > hi).alias("above_range"),
    )


def quartile_segments(df: DataFrame, field: str, *, rows: int | None = None) -> DataFrame:
    """Counts and shares below Q1, up to the median, up to Q3, and the rest."""
    values = df.select(number_of(df, field).alias("value")).where("value IS NOT NULL")
    q = ordering.quantiles(
        values, [], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75},
        aggs=[F.min("value").alias("lo"), F.max("value").alias("hi")],
        rows=ordering.count_rows(df, rows),
    ).select(F.struct("q1", "median", "q3", "lo", "hi").alias("q"))
    tagged = values.withColumn("q", q.scalar())
    v = F.col("value")
    segment = (
        F.when(F.col("q.lo") == F.col("q.hi"), 0)
        .when(v < F.col("q.q1"), 1).when(v < F.col("q.median"), 2).when(v < F.col("q.q3"), 3)
        .otherwise(4)
    )
    counts = tagged.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("count"))
    same = F.col("q.lo") == F.col("q.hi")
    frame = q.where("q.lo IS NOT NULL").select(
        "q", F.explode(F.when(same, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4))))).alias("segment")
    )
    joined = frame.join(F.broadcast(counts), "segment", "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )
    total = values.agg(F.count(F.lit(1)).alias("n")).scalar()
    name = F.element_at(
        F.array(*map(F.lit, ("全部数据相同", "低于 Q1", "Q1 至中位数", "中位数至 Q3", "Q3 及以上"))),
        F.col("segment") + 1,
    )
    return joined.select(
        "segment", name.alias("name"), "count",
        (F.col("count") / total * 100.0).alias("percentage"),
        F.col("q.q1").alias("q1"), F.col("q.median").alias("median"), F.col("q.q3").alias("q3"),
        same.alias("all_same"),
    )


def axis_maximum(df: DataFrame, field: str) -> DataFrame:
    """Upper axis limit: known full marks, else the maximum rounded up to tens, else 100."""
    for word, full in AXIS_MAX_BY_WORD:
        if word in field:
            top = F.lit(float(full))
            return df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(field).alias("field"), top.alias("axis_max")
            )
    highest = F.max(number_of(df, field))
    top = F.coalesce(F.ceil(highest / 10.0).cast("double") * 10.0, F.lit(100.0))
    return df.agg(top.alias("axis_max")).select(F.lit(field).alias("field"), "axis_max")


def _cumulative(df: DataFrame, field: str, rows: int | None, reread: bool = False) -> DataFrame:
    values = df.select(number_of(df, field).alias("value"))
    rows = ordering.count_rows(df, rows)
    limits = ordering.range_limits(values, F.col("value"), rows)
    cum = ordering.cumulative_counts(
        ordering.value_counts(values, [], "value"), [], "value", limits
    )
    # a large result that is read more than once is written once
    return ordering.fixed(cum) if limits and reread else cum


def cdf(df: DataFrame, field: str, *, rows: int | None = None) -> DataFrame:
    """One point per distinct value: share of numbers <= value, in percent."""
    at_most = F.col("n_below") + F.col("n_equal")
    return _cumulative(df, field, rows).select(
        "value", (at_most / F.col("n_total") * 100.0).alias("percentile")
    )


def ranked_records(
    df: DataFrame, field: str, direction: str = "higher-is-better", *, rows: int | None = None,
    digits: int = 4,
) -> DataFrame:
    """Every row with its percentile and its best and worst rank in the field.

    Ranks are worked out once per distinct value and joined back on the value;
    rows without a number get nulls.
    """
    cum = _cumulative(df, field, rows, reread=True)
    at_most = F.col("n_below") + F.col("n_equal")
    at_least = F.col("n_total") - F.col("n_below")
    if direction == "lower-is-better":
        share, ahead = at_least, F.col("n_below")
    else:
        share, ahead = at_most, F.col("n_total") - at_most
    marks = cum.select(
        F.col("value").alias("_mark_value"),
        half_up(share / F.col("n_total") * 100.0, digits).alias("percentile"),
        (ahead + 1).alias("best_rank"),
        (ahead + F.col("n_equal")).alias("worst_rank"),
        ordering.is_hot(F.col("n_equal"), F.col("n_total")).alias("_hot"),
    )
    return ordering.attach_by_value(
        df, number_of(df, field), marks, "_mark_value", F.col("_hot"),
        ["percentile", "best_rank", "worst_rank"],
    )
