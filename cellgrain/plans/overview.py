"""Whole-table overviews built from column types, summaries and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrain.functions import dates
from cellgrain.operators import ordering
from cellgrain.operators.cells import time_ms_of
from cellgrain.operators.outliers import outlier_status, plain_outliers
from cellgrain.operators.stats import category_counts, numeric_summary
from cellgrain.plans import profile

HIGH_MISSING = 0.3


def _types(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Column counts and the feature type of each column (one row per column on the driver)."""
    counts = profile.kept_small(profile.column_counts(df, fields))
    types = {r["field"]: r["feature_type"] for r in profile.feature_types(counts).collect()}
    return counts, types


def dataset_overview(
    df: DataFrame, fields: Sequence[str] | None = None, *, rows: int | None = None
) -> DataFrame:
    """Per column: type, missing cells, numeric summary and guarded outlier counts."""
    fields = list(fields or df.columns)
    rows = ordering.count_rows(df, rows)
    counts, types = _types(df, fields)
    base = profile.feature_types(counts).join(
        F.broadcast(counts.select("field", "total", "filled")), "field"
    )
    numeric = [f for f in fields if types[f] == "numerical"]
    columns = ("valid_count", "missing_count", "min", "max", "mean", "median", "std", "q1", "q3", "iqr")
    if numeric:
        summary = numeric_summary(df, numeric, rows=rows).drop("count")
        found = outlier_status(df, numeric, rows=rows).select(
            "field", F.col("status").alias("outlier_status"), "outlier_count"
        )
        base = base.join(F.broadcast(summary), "field", "left").join(F.broadcast(found), "field", "left")
    else:
        for c in columns:
            base = base.withColumn(c, F.lit(None).cast("double"))
        base = base.withColumn("outlier_status", F.lit(None).cast("string")).withColumn(
            "outlier_count", F.lit(None).cast("bigint")
        )
    missing = F.coalesce(F.col("missing_count"), F.col("total") - F.col("filled")).cast("bigint")
    return base.select(
        "ordinal", "field", "feature_type", F.col("total").alias("row_count"),
        missing.alias("missing_count"),
        ((F.col("feature_type") != "invalid") & (missing > F.col("total") * HIGH_MISSING)).alias("high_missing"),
        *[c for c in columns if c != "missing_count"],
        "outlier_status", "outlier_count",
    )


def type_counts(overview: DataFrame) -> DataFrame:
    return overview.groupBy("feature_type").agg(F.count(F.lit(1)).alias("fields"))


def dataset_profile(
    df: DataFrame, fields: Sequence[str] | None = None, *, top: int = 10, rows: int | None = None
) -> DataFrame:
    """Per analysable column: numeric summary, top categories or time range, plus a sentence.

    Identifier, text-only and unrecognised columns give no row.  All rows are used.
    """
    fields = list(fields or df.columns)
    rows = ordering.count_rows(df, rows)
    counts, types = _types(df, fields)
    by_type = {t: [f for f in fields if types[f] == t] for t in ("numerical", "categorical", "temporal")}
    null_d, null_l, null_s = (F.lit(None).cast(t) for t in ("double", "bigint", "string"))
    frames = []
    if by_type["numerical"]:
        s = numeric_summary(df, by_type["numerical"], rows=rows)
        frames.append(s.select(
            "field", F.lit("numerical").alias("feature_type"), "count", "valid_count", "missing_count",
            "min", "max", "mean", "std", null_l.alias("unique_count"), null_s.alias("top_categories"),
            null_s.alias("_best"), null_l.alias("_times"),
        ))
    if by_type["categorical"]:
        # a categorical column has few values, so all of them fit one list
        listed = category_counts(df, by_type["categorical"]).groupBy("field").agg(
            F.sum("n").alias("valid_count"), F.count(F.lit(1)).alias("unique_count"),
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("key"), "value", "n"))).alias("_c"),
        )
        shown = F.transform(F.slice("_c", 1, top), lambda s: F.concat(s["value"], F.lit("="), s["n"].cast("string")))
        totals = counts.select("field", F.col("total").cast("bigint").alias("count"))
        frames.append(
            listed.join(F.broadcast(totals), "field").select(
                "field", F.lit("categorical").alias("feature_type"), "count", "valid_count",
                (F.col("count") - F.col("valid_count")).cast("bigint").alias("missing_count"),
                null_d.alias("min"), null_d.alias("max"), null_d.alias("mean"), null_d.alias("std"),
                "unique_count", F.array_join(shown, "; ").alias("top_categories"),
                F.get("_c", F.lit(0))["value"].alias("_best"), F.get("_c", F.lit(0))["n"].alias("_times"),
            )
        )
    if times := by_type["temporal"]:
        every = {f: time_ms_of(df, f, wide=True) for f in times}
        one = df.agg(F.count(F.lit(1)).alias("count"), *[
            F.struct(F.lit(f).alias("field"), F.count(ms).alias("valid_count"), F.min(ms).cast("double").alias("min"), F.max(ms).cast("double").alias("max")).alias(f"_t{k}")
            for k, (f, ms) in enumerate(every.items())
        ])
        frames.append(one.select("count", F.inline(F.array(*[F.col(f"_t{k}") for k in range(len(times))]))).select(
            "field", F.lit("temporal").alias("feature_type"),
            "count", "valid_count", (F.col("count") - F.col("valid_count")).cast("bigint").alias("missing_count"),
            "min", "max", null_d.alias("mean"), null_d.alias("std"),
            null_l.alias("unique_count"), null_s.alias("top_categories"), null_s.alias("_best"), null_l.alias("_times"),
        ))
    schema = (
        "field string, feature_type string, count bigint, valid_count bigint, missing_count bigint, "
        "min double, max double, mean double, std double, unique_count bigint, top_categories string, _best string, _times bigint"
    )
    out = df.sparkSession.createDataFrame([], schema)
    for frame in frames:
        out = out.unionByName(frame)
    insight = (
        F.when(
            F.col("feature_type") == "categorical",
            F.concat(
                F.col("unique_count").cast("string"), F.lit(" 个类别"),
                F.when(F.col("_times").isNotNull(), F.concat(F.lit("，最多为 "), "_best", F.lit(" × "), F.col("_times").cast("string"))).otherwise(""),
            ),
        )
        .when(
            F.col("feature_type") == "temporal",
            F.concat(F.lit("时间范围 "), dates.day_text(F.col("min")), F.lit(" 到 "), dates.day_text(F.col("max"))),
        )
        .when(F.col("valid_count") == 0, "0 个有效值")
        .otherwise(F.concat(
            F.col("valid_count").cast("string"),
            F.format_string(" 个有效值，%.2f 至 %.2f，均值 %.2f，标准差 %.2f", "min", "max", "mean", "std"),
        ))
    )
    return out.withColumn("insight", insight).drop("_best", "_times")


def dataset_anomalies(
    df: DataFrame, fields: Sequence[str] | None = None, row_id: str = "_row_id", *, rows: int | None = None
) -> DataFrame:
    """Unguarded outliers of every numeric column with severity (|z| > 3 is high) and a sentence."""
    fields = [f for f in (fields or df.columns) if f != row_id]
    _, types = _types(df, fields)
    numeric = [f for f in fields if types[f] == "numerical"]
    if not numeric:
        return df.sparkSession.createDataFrame(
            [], f"{row_id} bigint, field string, value double, z_score double, severity string, description string"
        )
    return plain_outliers(df, numeric, row_id, rows=rows).withColumns({
        "severity": F.when(F.abs("z_score") > 3, "high").otherwise("medium"),
        "description": F.format_string("值 %.2f，z = %.2f", "value", "z_score"),
    })


def dataset_warnings(counts: DataFrame) -> DataFrame:
    """Number of columns without a recognised type."""
    return profile.feature_types(counts).agg(
        F.count_if(F.col("feature_type") == "invalid").alias("unrecognised_fields")
    )


