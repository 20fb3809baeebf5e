"""Typed or textual columns seen through one cell model.

A string column takes the full dirty-cell rules.  A numeric column is used as
is (NaN and infinities become null).  Dates and booleans are never numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.functions import dates, numbers, text

KIND_NUMBER, KIND_TIME, KIND_FLAG, KIND_TEXT = "number", "time", "flag", "text"


def kind_of(df: DataFrame, name: str) -> str:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return KIND_FLAG
    if isinstance(dtype, T.NumericType):
        return KIND_NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return KIND_TIME
    return KIND_TEXT


def ref(name: str) -> Column:
    """A column by its exact name, even when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_of(df: DataFrame, name: str) -> Column:
    kind = kind_of(df, name)
    if kind == KIND_NUMBER:
        return numbers.finite_or_null(ref(name))
    if kind == KIND_TEXT:
        return numbers.number(ref(name).cast("string"))
    return F.lit(None).cast("double")


def text_of(df: DataFrame, name: str) -> Column:
    """The cell as text; whole doubles print without a fraction."""
    c = ref(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.floor(c).cast("double") == c) & (F.abs(c) < F.lit(1e15))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def status_of(df: DataFrame, name: str) -> Column:
    kind = kind_of(df, name)
    if kind == KIND_TEXT:
        return numbers.number_status(ref(name).cast("string"))
    if kind == KIND_NUMBER:
        return (
            F.when(ref(name).isNull(), "empty")
            .when(number_of(df, name).isNotNull(), "valid")
            .otherwise("invalid")
        )
    return F.when(ref(name).isNull(), "empty").otherwise("invalid")


def time_ms_of(df: DataFrame, name: str, wide: bool = False) -> Column:
    """Epoch milliseconds of a time cell; ``wide`` adds the looser date shapes."""
    c = ref(name)
    if kind_of(df, name) == KIND_TIME:
        if isinstance(df.schema[name].dataType, T.DateType):
            return F.unix_date(c).cast("bigint") * F.lit(86_400_000)
        if isinstance(df.schema[name].dataType, T.TimestampNTZType):
            return dates.wall_clock_ms(c)
        return F.unix_millis(c.cast("timestamp"))
    t = text_of(df, name)
    return dates.temporal_ms(t) if wide else dates.parse_date_ms(t)


def long_numbers(df: DataFrame, fields: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """``(*ids, field, value)`` with one row per cell; unusable cells keep a null value."""
    picked = df.select(
        *[ref(i).alias(i) for i in ids], *[number_of(df, f).alias(f) for f in fields]
    )
    return picked.unpivot(
        [ref(i) for i in ids], [ref(f) for f in fields], "field", "value"
    )


def standardized(df: DataFrame, name: str, feature_type: str) -> Column:
    """Tagged value ``struct<type, num, str, ms, original>`` of one cell.

    ``type`` is the feature type, or 'missing' for a blank cell, or 'invalid'
    when the cell does not fit its type.
    """
    raw = text_of(df, name)
    original = text.normalize_cell(raw)
    num = number_of(df, name) if feature_type == "numerical" else F.lit(None).cast("double")
    ms = time_ms_of(df, name, wide=True) if feature_type == "temporal" else F.lit(None).cast("bigint")
    keeps_text = feature_type in ("categorical", "text", "identifier")
    if feature_type == "numerical":
        tag = F.when(num.isNotNull(), "numerical").otherwise("invalid")
    elif feature_type == "temporal":
        tag = F.when(ms.isNotNull(), "temporal").otherwise("invalid")
    elif keeps_text:
        tag = F.lit(feature_type)
    else:
        tag = F.lit("invalid")
    missing = original == ""
    return F.struct(
        F.when(missing, "missing").otherwise(tag).alias("type"),
        F.when(~missing, num).alias("num"),
        (F.when(~missing, original) if keeps_text else F.lit(None).cast("string")).alias("str"),
        F.when(~missing, ms).alias("ms"),
        original.alias("original"),
    )


def standardize(
    df: DataFrame, feature_types: Mapping[str, str], ids: Sequence[str] = ("_row_id",)
) -> DataFrame:
    """One tagged struct per column, in a single projection."""
    return df.select(
        *[ref(i) for i in ids],
        *[standardized(df, f, t).alias(f) for f, t in feature_types.items()],
    )


def tagged_values(std: DataFrame, name: str, tag: str) -> DataFrame:
    """Values of one standardised column that carry the wanted tag."""
    part = {"numerical": "num", "temporal": "ms"}.get(tag, "str")
    c = ref(name)
    return std.where(c["type"] == tag).select(c[part].alias("value"))


def is_analyzable(std_cell: Column) -> Column:
    return std_cell["type"].isin("numerical", "temporal")


def original_value(std_cell: Column) -> Column:
    return std_cell["original"]
