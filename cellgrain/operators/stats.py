"""Descriptive statistics and positions of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.functions import dates, labels
from cellgrain.functions.numbers import half_up
from cellgrain.operators import ordering
from cellgrain.operators.cells import long_numbers, number_of, ref, text_of, time_ms_of
from cellgrain.functions.text import is_blank, trimmed

# Header words of rank columns.
RANK_WORDS = ("名次", "排名", "位次")

METRIC_QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}
DIRECTIONAL = ("higher-is-better", "lower-is-better")


@dataclass(frozen=True)
class Metric:
    """A numeric field and how to judge it."""

    name: str
    direction: str = "unspecified"
    display_name: str = ""
    recommended: bool = False


def is_rank_field(name: str, role: str | None = None) -> bool:
    """Whether smaller numbers are better, judged by role or header (known at plan time)."""
    return role == "rank" or any(w in name.lower() for w in RANK_WORDS)


def min_max(df: DataFrame, field: str) -> DataFrame:
    v = number_of(df, field)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"))


def stable_moments(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Mean and population deviation that survive values near the double limit.

    First pass: count and scale per field.  Second pass: values are divided before
    they are added, so no intermediate sum or square overflows.
    """
    cells = long_numbers(df, fields)
    first = cells.groupBy("field").agg(
        F.count("value").alias("n"), F.max(F.abs("value")).alias("scale")
    )
    # one row per field
    joined = cells.where(F.col("value").isNotNull()).join(F.broadcast(first), "field")
    unit = F.try_divide(F.col("value"), F.col("scale"))
    moments = joined.groupBy("field").agg(
        F.sum(F.col("value") / F.col("n")).alias("mean"),
        F.stddev_pop(unit).alias("_unit_std"),
        F.max("scale").alias("scale"),
    )
    return first.select("field", "n").join(moments, "field", "left").select(
        "field",
        F.col("n").alias("valid_count"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce(F.col("_unit_std") * F.col("scale"), F.lit(0.0)).alias("std"),
    )


def numeric_summary(
    df: DataFrame, fields: Sequence[str], *, digits: int = 4, method: str = "exact",
    rows: int | None = None,
) -> DataFrame:
    """Per field: counts over all rows, range, mean, deviation, quartiles; rounded."""
    cells = long_numbers(df, fields)
    rows = ordering.count_rows(df, rows) if method == "exact" else None
    raw = ordering.quantiles(
        cells, ["field"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75},
        aggs=[
            F.count(F.lit(1)).alias("count"),
            F.count("value").alias("valid_count"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        ],
        method=method, rows=rows, few_keys=True,
    )

    def r(c: Column) -> Column:
        return half_up(c, digits)

    return raw.select(
        "field", "count", "valid_count",
        (F.col("count") - F.col("valid_count")).alias("missing_count"),
        *[r(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std", "q1", "q3")],
        r(F.col("q3") - F.col("q1")).alias("iqr"),
    )


def suitable_fields(df: DataFrame, fields: Sequence[str], min_valid: int = 5) -> DataFrame:
    """Which fields hold enough numbers for numeric analysis, and which are mostly numeric."""
    return (
        long_numbers(df, fields)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("valid_count"))
        .select(
            "field", "rows", "valid_count",
            (F.col("valid_count") >= min_valid).alias("suitable"),
            (F.col("valid_count") >= F.col("rows") * 0.5).alias("is_numeric"),
        )
    )


def metric_stats(
    df: DataFrame, fields: Sequence[str], *, method: str = "exact", rows: int | None = None
) -> DataFrame:
    """Per field: valid/invalid counts, range, mean, quantiles.  Fields without numbers give no row."""
    cells = long_numbers(df, fields)
    rows = ordering.count_rows(df, rows) if method == "exact" else None
    raw = ordering.quantiles(
        cells, ["field"], "value", METRIC_QUANTILES,
        aggs=[
            F.count("value").alias("valid_count"),
            (F.count(F.lit(1)) - F.count("value")).alias("invalid_count"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
        ],
        method=method, rows=rows, few_keys=True,
    )
    return raw.where("valid_count > 0").select(
        "field", F.col("valid_count").alias("count"), "valid_count", "invalid_count",
        "min", "max", "mean", "median", "q25", "q75", "q90", "q95",
    )


def position_columns(
    higher: Column, equal: Column, lower: Column, total: Column,
    low: Column, high: Column, x: Column, direction: Column,
) -> list[Column]:
    """Rank interval, percentile and range flags from the three counts."""
    reverse = direction == "lower-is-better"
    ahead = F.when(reverse, lower).otherwise(higher)
    within = F.when(reverse, higher + equal).otherwise(lower + equal)
    outside = F.when(x < low, "below").when(x > high, "above")
    return [
        total.alias("total"),
        higher.alias("higher_count"),
        equal.alias("equal_count"),
        lower.alias("lower_count"),
        (ahead + 1).alias("best_rank"),
        (ahead + equal).alias("worst_rank"),
        (ahead + 1).alias("estimated_rank"),
        F.coalesce(F.try_divide(within, total) * 100.0, F.lit(0.0)).alias("percentile"),
        (equal > 0).alias("exists_in_data"),
        outside.isNotNull().alias("is_out_of_range"),
        outside.alias("out_of_range_direction"),
    ]


def position(
    df: DataFrame, field: str, x: float, direction: str = "higher-is-better"
) -> DataFrame:
    """Where one input value stands among the numbers of a field; a single aggregate."""
    v = number_of(df, field)
    counted = df.agg(
        F.count_if(v > x).alias("h"), F.count_if(v == x).alias("e"), F.count_if(v < x).alias("l"),
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    c = F.col
    return counted.select(
        F.lit(field).alias("field"), F.lit(float(x)).alias("x"),
        *position_columns(
            c("h"), c("e"), c("l"), c("n"), c("lo"), c("hi"), F.lit(float(x)), F.lit(direction)
        ),
    )


def positions(
    df: DataFrame, field: str, inputs: DataFrame, x: str = "x",
    direction: str = "higher-is-better", *, rows: int | None = None,
) -> DataFrame:
    """Positions of a whole column of input values.

    Inputs enter the value counts with weight 0, so one cumulative count answers
    all of them; the answers come back by an equality join on the value.
    """
    # the inputs are ranged together with the table's values, so both count
    rows = ordering.count_rows(df, rows) + ordering.count_rows(inputs)
    values = df.select(number_of(df, field).alias("value"))
    asked = inputs.select(number_of(inputs, x).alias("value")).where("value IS NOT NULL")
    asked_counts = ordering.value_counts(asked, [], "value").withColumnRenamed("n_equal", "_asked")
    counts = (
        ordering.value_counts(values, [], "value").withColumn("_asked", F.lit(0).cast("bigint"))
        .unionByName(asked_counts.withColumn("n_equal", F.lit(0).cast("bigint")))
        .groupBy("value")
        .agg(F.sum("n_equal").alias("n_equal"), F.sum("_asked").alias("_asked"))
    )
    limits = ordering.range_limits(values.union(asked), F.col("value"), rows)
    cum = ordering.cumulative_counts(counts, [], "value", limits).where("_asked > 0")
    if limits:
        # read twice below, so written once; it holds the asked values only
        cum = ordering.fixed(cum)
    n_total = F.col("n_total")
    above = n_total - F.col("n_below") - F.col("n_equal")
    # Nothing at or below the input, or nothing at or above it: it lies outside the data.
    outside = F.when(
        (F.col("n_equal") == 0) & (n_total > 0),
        F.when(F.col("n_below") == 0, "below").when(above == 0, "above"),
    )
    unknown = F.lit(None).cast("double")
    cols = position_columns(
        above, F.col("n_equal"), F.col("n_below"), n_total, unknown, unknown, F.col("value"),
        F.lit(direction),
    )[:-2]
    total_asked = F.coalesce(asked.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0))
    answers = cum.select(
        F.col("value").alias("_answer_value"), *cols,
        outside.isNotNull().alias("is_out_of_range"), outside.alias("out_of_range_direction"),
        ordering.is_hot(F.col("_asked"), total_asked).alias("_hot"),
    )
    names = [c for c in answers.columns if c not in ("_answer_value", "_hot")]
    return ordering.attach_by_value(
        inputs, number_of(inputs, x), answers, "_answer_value", F.col("_hot"), names
    )


def percentile_of_value(df: DataFrame, field: str, x: float, rank_field: bool = False) -> DataFrame:
    """Share (0-100) of numbers <= x, or >= x for a rank-like field; 0 without numbers."""
    v = number_of(df, field)
    hit = F.count_if(v >= x) if rank_field else F.count_if(v <= x)
    return df.agg(
        F.coalesce(F.try_divide(hit, F.count(v)) * 100.0, F.lit(0.0)).alias("percentile")
    ).select(F.lit(field).alias("field"), F.lit(float(x)).alias("x"), "percentile")


def compute_metrics(
    df: DataFrame, metrics: Sequence[Metric], inputs: Mapping[str, float] | None = None,
    *, method: str = "exact", rows: int | None = None,
) -> DataFrame:
    """Statistics of many metrics, plus positions of the inputs of directional ones.

    All metrics share one unpivoted aggregate; an input becomes three conditional
    counts in it.
    """
    inputs = dict(inputs or {})
    fields = [m.name for m in metrics]
    asked = {
        m.name: float(inputs[m.name])
        for m in metrics
        if m.name in inputs and m.direction in DIRECTIONAL
    }
    x = F.lit(None).cast("double")
    direction, display = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in metrics:
        here = F.col("field") == m.name
        direction = F.when(here, F.lit(m.direction)).otherwise(direction)
        display = F.when(here, F.lit(m.display_name or m.name)).otherwise(display)
        if m.name in asked:
            x = F.when(here, F.lit(asked[m.name])).otherwise(x)
    rows = ordering.count_rows(df, rows) if method == "exact" else None
    raw = ordering.quantiles(
        long_numbers(df, fields), ["field"], "value", METRIC_QUANTILES,
        aggs=[
            F.count(F.lit(1)).alias("total_rows"),
            F.count("value").alias("valid_count"),
            F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
            F.count_if(F.col("value") > x).alias("_h"),
            F.count_if(F.col("value") == x).alias("_e"),
            F.count_if(F.col("value") < x).alias("_l"),
        ],
        method=method, rows=rows, few_keys=True,
    )
    has = x.isNotNull() & (F.col("valid_count") > 0)
    place = position_columns(
        F.col("_h"), F.col("_e"), F.col("_l"), F.col("valid_count"),
        F.col("min"), F.col("max"), x, direction,
    )
    names = [
        "total", "higher_count", "equal_count", "lower_count", "best_rank", "worst_rank",
        "estimated_rank", "percentile", "exists_in_data", "is_out_of_range", "out_of_range_direction",
    ]
    return raw.select(
        F.col("field").alias("metric"), display.alias("display_name"), direction.alias("direction"),
        "total_rows", "valid_count", (F.col("total_rows") - F.col("valid_count")).alias("invalid_count"),
        "min", "max", "mean", *METRIC_QUANTILES, x.alias("user_value"),
        *[F.when(has, p).alias(n) for p, n in zip(place, names)],
    )


def category_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows per distinct non-blank value of each field."""
    cells = df.select(*[text_of(df, f).alias(f) for f in fields]).unpivot(
        [], [ref(f) for f in fields], "field", "value"
    )
    return (
        cells.where(~is_blank(F.col("value")))
        .groupBy("field", trimmed(F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_top_n(df: DataFrame, fields: Sequence[str], n: int = 10) -> DataFrame:
    """The most frequent values of each field; ties by value.

    The rank filter lets Spark keep only n rows per field and task before the shuffle.
    """
    order = W.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return (
        category_counts(df, fields)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


# Values that a task tracks for top_values.
TRACKED = 1 << 14


def top_values(df: DataFrame, field: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """``(value, n, rank)`` of the n most frequent non-blank values, exact, without an exchange of all distinct values.

    A mergeable sketch of ``tracked`` values names candidates, and a second scan counts those.  A value that is no candidate
    occurs at most as often as the least estimate of a full list of candidates, or twice the sketch's error, 3.5 rows in
    ``tracked``.  If the n-th candidate is above that, the answer is proven; if not, all values are counted.  Ties go by value.
    """
    cells = df.select(trimmed(text_of(df, field)).alias("value")).where(~is_blank(F.col("value")))
    asked = min(tracked, 4 * n + 100)
    got = cells.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(value, {asked}, {tracked})").alias("top")).first()
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")  # over a few rows, or n per task
    if got["rows"]:
        # at most ``asked`` rows
        named = df.sparkSession.createDataFrame([(x["item"],) for x in got["top"]], "value string")
        counted = cells.join(F.broadcast(named), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()
        least = min(x["count"] for x in got["top"]) if len(got["top"]) >= asked else 0
        bound = max(least, 7 * got["rows"] / tracked)
        if sum(r["n"] > bound for r in counted) >= n:
            exact = df.sparkSession.createDataFrame([tuple(r) for r in counted], "value string, n bigint")
            return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    whole = cells.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def time_range(df: DataFrame, field: str) -> DataFrame:
    ms = time_ms_of(df, field, wide=True)
    return df.agg(
        F.count(F.lit(1)).alias("count"),
        F.count(ms).alias("valid_count"),
        (F.count(F.lit(1)) - F.count(ms)).alias("missing_count"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
    ).select(
        F.lit(field).alias("field"), "*",
        dates.day_text(F.col("min_ms")).alias("min_date"),
        dates.day_text(F.col("max_ms")).alias("max_date"),
    )


def five_numbers(df: DataFrame, field: str, x: float | None = None, rows: int | None = None) -> DataFrame:
    """Box-plot summary, with the zone an input value falls in."""
    cells = long_numbers(df, [field])
    got = ordering.quantiles(
        cells, ["field"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75},
        aggs=[F.min("value").alias("min"), F.max("value").alias("max")],
        rows=ordering.count_rows(df, rows),
    )
    out = got.select("field", "min", "q25", "median", "q75", "max")
    if x is not None:
        out = out.withColumn(
            "zone", labels.box_zone(F.lit(float(x)), F.col("q25"), F.col("median"), F.col("q75"))
        )
    return out
