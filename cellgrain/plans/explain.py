"""Verdicts on one record's values, or on every record, against a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.functions import labels
from cellgrain.functions.numbers import is_finite, normalize_score
from cellgrain.operators import ordering
from cellgrain.operators.cells import long_numbers, number_of, ref

NEUTRAL = ("neutral", "unspecified")


def explain_values(
    df: DataFrame, inputs: Mapping[str, float], *, rank_fields: Sequence[str] = (),
    directions: Mapping[str, str] | None = None, rows: int | None = None,
) -> DataFrame:
    """Per input field: mean, percentile, tier and distances to mean, p75, p90, p95.

    Neutral fields get percentile 0 and a neutral label.  Fields without numbers and
    unusable inputs give no row.  All fields share one aggregate.
    """
    directions = directions or {}
    asked = {f: float(x) for f, x in inputs.items() if x is not None and isfinite(float(x))}
    fields = list(asked)
    x, ordinal = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, f in enumerate(fields):
        here = F.col("field") == f
        x = F.when(here, F.lit(asked[f])).otherwise(x)
        ordinal = F.when(here, F.lit(k)).otherwise(ordinal)
    reverse = F.col("field").isin(*rank_fields) if rank_fields else F.lit(False)
    plain = [f for f in fields if directions.get(f) in NEUTRAL]
    neutral = F.col("field").isin(*plain) if plain else F.lit(False)
    v = F.col("value")
    got = ordering.quantiles(
        long_numbers(df, fields), ["field"], "value", {"q75": 0.75, "q90": 0.9, "q95": 0.95},
        aggs=[
            F.count("value").alias("valid_count"), F.avg("value").alias("mean"),
            F.count_if(F.when(reverse, v > x).otherwise(v < x)).alias("_passed"),
            F.count_if(F.when(reverse, v >= x).otherwise(v <= x)).alias("_within"),
        ],
        rows=ordering.count_rows(df, rows), few_keys=True,
    ).where("valid_count > 0")
    percentile = F.when(neutral, F.lit(0.0)).otherwise(F.col("_within") / F.col("valid_count") * 100.0)
    return got.withColumn("percentile", percentile).select(
        ordinal.alias("ordinal"), "field", x.alias("user_value"), "mean",
        F.when(neutral, F.lit(0)).otherwise(F.col("_passed")).cast("bigint").alias("lower_count"),
        "percentile",
        F.when(neutral, "middle").otherwise(labels.tier(F.col("percentile"))).alias("tier"),
        F.when(neutral, "中性指标").otherwise(labels.tier_label(F.col("percentile"))).alias("tier_label"),
        (x - F.col("mean")).alias("diff_from_mean"),
        (x - F.col("q75")).alias("diff_from_p75"),
        (x - F.col("q90")).alias("diff_from_p90"),
        (x - F.col("q95")).alias("diff_from_p95"),
        "valid_count",
    )


def summarize_explanations(explained: DataFrame, n: int = 3) -> DataFrame:
    """One row: best and worst fields with their percentiles, mean percentile, whether there are enough fields.

    Works on one row per asked field.
    """
    items = F.sort_array(F.collect_list(F.struct(
        (-F.col("percentile")).alias("key"), "ordinal", "field", "percentile"
    )))
    got = explained.agg(
        items.alias("i"), F.avg("percentile").alias("p"), F.count(F.lit(1)).alias("field_count")
    )

    def named(part):
        return F.array_join(F.transform(part, lambda s: s["field"]), ",")

    last = F.reverse(F.slice(F.col("i"), F.greatest(F.lit(1), F.col("field_count").cast("int") - n + 1), n))
    first = F.slice(F.col("i"), 1, n)
    return got.select(
        named(first).alias("top_fields"), F.transform(first, lambda s: s["percentile"]).alias("top_percentiles"),
        named(last).alias("bottom_fields"), F.transform(last, lambda s: s["percentile"]).alias("bottom_percentiles"),
        F.coalesce("p", F.lit(0.0)).alias("average_percentile"), "field_count",
        (F.col("field_count") < n).alias("insufficient_data"),
    )


def field_profile(
    df: DataFrame, inputs: Mapping[str, float], directions: Mapping[str, str] | None = None,
    best: int = 2, *, rows: int | None = None,
) -> DataFrame:
    """Percentile of one record in each field, sorted, with its best and worst fields marked."""
    directions = directions or {}
    low = [f for f in inputs if directions.get(f) in ("lower_is_better", "lower-is-better")]
    got = explain_values(df, inputs, rank_fields=low, rows=rows)
    # one row per asked field
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.desc("percentile"), "ordinal")
    position, n = F.row_number().over(order), F.count(F.lit(1)).over(everything)
    ranked = got.withColumn("position", position).withColumn("_n", n)
    mark = (
        F.when((F.col("_n") >= 2) & (F.col("position") <= best), "advantage")
        .when((F.col("_n") >= 2) & (F.col("position") > F.col("_n") - best), "weakness")
    )
    return ranked.select(
        "position", "field", "user_value", "percentile", "mean", "valid_count", mark.alias("mark")
    )


# Up to so many fields a record's percentiles are columns of its row until the end; those of more fields are gathered in lists.
FEW_FIELDS = 16


def _in_columns(held: DataFrame, own: Sequence[str], marks: DataFrame, n: int) -> DataFrame:
    """``own`` and the percentiles ``_p0``, ``_p1``, ... of each record of ``held``.

    Hot values are looked up in the record's own row; only the others leave it to meet theirs, and come back by record.
    """
    # read once per field; the hot values of all fields, so few
    few = ordering.fixed(marks.where("_hot").coalesce(1))
    names = [f"_p{k}" for k in range(n)]
    for k in range(n):
        mine = few.where(F.col("_field") == k).select(F.col("_value").alias("_mark"), F.col("_percentile").alias(names[k]))
        held = held.join(F.broadcast(mine), F.col(f"_v{k}") + F.lit(0.0) == F.col("_mark"), "left").drop("_mark")
    cold = held.select(*own, F.inline(F.array(*[
        F.struct(F.lit(k).alias("_field"), F.when(F.col(names[k]).isNull(), F.col(f"_v{k}") + F.lit(0.0)).alias("_value")) for k in range(n)
    ]))).where("_value IS NOT NULL")
    found = cold.join(marks.where("NOT _hot").drop("_hot"), ["_field", "_value"]).select(
        *own, *[F.when(F.col("_field") == k, F.col("_percentile")).alias(names[k]) for k in range(n)]
    )
    # records meet before they are merged: the tasks before the exchange hold hardly any record twice
    return held.select(*own, *names).unionByName(found).repartition("_record").groupBy(*own).agg(*[F.max(p).alias(p) for p in names])


def _in_lists(cells: DataFrame, own: Sequence[str], marks: DataFrame, n: int) -> DataFrame:
    """As :func:`_in_columns`, from cells."""
    found = ordering.attach_by_keys(
        cells.where("_value IS NOT NULL"), ["_field", "_value"], marks, F.col("_hot"), ["_percentile"]
    )
    missing = cells.where("_value IS NULL").withColumn("_percentile", F.lit(None).cast("double"))
    # one entry per field
    got = found.unionByName(missing).groupBy(*own).agg(F.collect_list(
        F.when(F.col("_percentile").isNotNull(), F.struct("_field", "_percentile"))
    ).alias("_found"))
    return got.select(*own, *[
        F.get(F.filter("_found", lambda e: e["_field"] == F.lit(k)), F.lit(0))["_percentile"].alias(f"_p{k}") for k in range(n)
    ])


def record_profiles(
    df: DataFrame, fields: Sequence[str], directions: Mapping[str, str] | None = None,
    ids: Sequence[str] = ("_row_id",), best: int = 2, *, rows: int | None = None,
) -> DataFrame:
    """Percentile of every record in each of its fields, its best and worst fields, and its mean percentile.

    All fields are ranked together: distinct values of (field, value) are counted, ranked by one range partitioning, and
    joined back once per value, a frequent one by broadcast. The number of shuffles does not depend on the number of
    fields. Records need no unique id: they are numbered when their columns are written. A field without a number in the record is left
    out of it; best and worst are null for records with fewer than two fields. Ties go by the order of ``fields``.
    """
    low = [f for f in fields if (directions or {}).get(f) in ("lower_is_better", "lower-is-better")]
    rows = ordering.count_rows(df, rows)
    # the number is part of what is written, so lost tasks do not change it
    held = ordering.fixed(
        df.select(*[ref(i).alias(f"_id{k}") for k, i in enumerate(ids)], *[number_of(df, f).alias(f"_v{k}") for k, f in enumerate(fields)])
        .withColumn("_record", F.monotonically_increasing_id())
    )
    own = ["_record", *[f"_id{k}" for k in range(len(ids))]]
    cells = held.select(*own, F.inline(F.array(*[
        F.struct(F.lit(k).alias("_field"), (F.col(f"_v{k}") + F.lit(0.0)).alias("_value")) for k in range(len(fields))
    ])))
    counts = ordering.value_counts(cells, ["_field"], "_value")
    ranked = ordering.ranked_counts(counts, ["_field"], "_value", rows * len(fields))
    within = F.col("n_below") + F.col("n_equal")
    if low:
        reverse = F.col("_field").isin(*[k for k, f in enumerate(fields) if f in low])
        within = F.when(reverse, F.col("n_total") - F.col("n_below")).otherwise(within)
    marks = ordering.fixed(ranked.select(
        "_field", "_value", (within / F.col("n_total") * 100.0).alias("_percentile"),
        ordering.is_hot(F.col("n_equal"), F.col("n_total")).alias("_hot"),
    ))
    if len(fields) <= FEW_FIELDS:
        got = _in_columns(held, own, marks, len(fields))
    else:
        got = _in_lists(cells, own, marks, len(fields))
    percentiles = [F.col(f"_p{k}") for k in range(len(fields))]
    # highest first, then by the order of the fields; fields without a number come last
    order = F.sort_array(F.array(*[
        F.when(p.isNotNull(), F.struct(p.alias("share"), F.lit(-k).alias("at"), F.lit(f).alias("name")))
        for k, (p, f) in enumerate(zip(percentiles, fields, strict=True))
    ]), asc=False)
    total = F.aggregate(F.array(*percentiles), F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))
    got = got.withColumns({"_order": order, "field_count": F.size(F.array_compact(F.array(*percentiles)))})
    n, most = F.col("field_count"), F.least(F.lit(best), F.col("field_count"))
    first = F.slice("_order", F.lit(1), most)
    last = F.reverse(F.slice("_order", F.greatest(F.lit(1), n - best + 1), most))

    def of(part: Column, name: str) -> Column:
        return F.when(n >= 2, part[name])

    return got.select(
        *[F.col(f"_id{k}").alias(i) for k, i in enumerate(ids)],
        *[p.alias(f"percentile_{f}") for p, f in zip(percentiles, fields, strict=True)],
        "field_count", of(first, "name").alias("advantages"), of(first, "share").alias("advantage_percentiles"),
        of(last, "name").alias("weaknesses"), of(last, "share").alias("weakness_percentiles"),
        F.try_divide(total, n).alias("average_percentile"),
    )


def score_profiles(
    df: DataFrame, max_scores: Mapping[str, float], ids: Sequence[str] = ("_row_id",), best: int = 2
) -> DataFrame:
    """Per record: score / full marks * 100 of each field, best and worst fields, average.

    Works inside each row on arrays, so nothing is shuffled.
    """
    fields = list(max_scores)
    numbers = df.select(*[ref(i).alias(i) for i in ids], *[F.col(f"`{f}`") for f in fields])
    entries = F.array(*[
        F.struct(
            (-normalize_score(F.col(f"`{f}`").cast("double"), F.lit(float(max_scores[f])))).alias("key"),
            F.lit(k).alias("ordinal"), F.lit(f).alias("field"),
            F.col(f"`{f}`").cast("double").alias("score"),
        )
        for k, f in enumerate(fields)
    ])
    usable = F.filter(
        entries, lambda e: F.coalesce(is_finite(e["score"]) & (e["score"] > 0) & (e["key"] < 0), F.lit(False))
    )
    got = numbers.select(*[ref(i).alias(i) for i in ids], F.array_sort(usable).alias("e"))
    n = F.size("e")

    def named(part):
        return F.array_join(F.transform(part, lambda s: s["field"]), ",")

    tail = F.reverse(F.slice(F.col("e"), F.greatest(F.lit(1), n - best + 1), best))
    total = F.aggregate(F.col("e"), F.lit(0.0), lambda acc, s: acc - s["key"])
    return got.select(
        *[ref(i).alias(i) for i in ids], n.alias("field_count"),
        F.when(n >= 2, named(F.slice(F.col("e"), 1, best))).alias("advantages"),
        F.when(n >= 2, named(tail)).alias("weaknesses"),
        F.when(n >= 2, F.try_divide(total, n)).alias("average_normalized"),
    )
