"""AND filters over dirty cells.

Conditions are literals known when the plan is built: their values are parsed
once, on the driver, by the same rules as cells.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.functions import numbers
from cellgrain.functions.text import WHITESPACE, normalize_cell
from cellgrain.operators.cells import KIND_NUMBER, KIND_TEXT, kind_of, number_of, ref, text_of

# Roles of older field metadata that always count as numbers.
NUMERIC_ROLES = ("primaryTotal", "rank", "sectionTotal", "courseScore", "adjustment")


@dataclass(frozen=True)
class Condition:
    """``field operator value``; a range may use ``low``/``high`` instead of value."""

    field: str
    operator: str
    value: str = ""
    low: str | None = None
    high: str | None = None


_LITERAL = re.compile(
    r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
)


def literal_number(value: object) -> float | None:
    """A condition literal as a number, by the cell rules."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    t = str(value).strip(WHITESPACE)
    if t.endswith("%"):
        t = t[:-1].strip(WHITESPACE)
    if not _LITERAL.fullmatch(t):
        return None
    x = float(t.replace(",", ""))
    return x if math.isfinite(x) else None


def between_bounds(cond: Condition) -> tuple[float, float] | None:
    """Limits of a range condition, or None when it is not usable.

    Separate limits win.  The old ``"80,90"`` form counts only with exactly one
    comma and when the whole text is not itself a number.
    """
    if cond.low is not None or cond.high is not None:
        pair = (cond.low, cond.high)
    else:
        t = str(cond.value or "").strip(WHITESPACE)
        if not t or literal_number(t) is not None or t.count(",") != 1:
            return None
        pair = tuple(t.split(","))
    low, high = literal_number(pair[0]), literal_number(pair[1])
    if low is None or high is None or low > high:
        return None
    return low, high


def migrate_condition(cond: Condition) -> Condition:
    """Old range text to separate limits when it is unambiguous; else unchanged."""
    if cond.operator != "between" or cond.low is not None or cond.high is not None:
        return cond
    bounds = between_bounds(cond)
    if bounds is None:
        return cond
    low, high = (str(int(b)) if b == int(b) else repr(b) for b in bounds)
    return replace(cond, value="", low=low, high=high)


def _empty_like(df: DataFrame, field: str) -> Column:
    if kind_of(df, field) != KIND_TEXT:
        return ref(field).isNull()
    return numbers.is_empty_like(text_of(df, field))


# operator -> comparison
_COMPARE = {
    "gt": lambda c, x: c > x,
    "lt": lambda c, x: c < x,
    "gte": lambda c, x: c >= x,
    "lte": lambda c, x: c <= x,
    "equals": lambda c, x: c == x,
}
# for whole numbers: the same test against a whole literal
_WHOLE_LIMIT = {"gt": math.floor, "lt": math.ceil, "gte": math.ceil, "lte": math.floor}


def _typed_compare(df: DataFrame, field: str, operator: str, x: float) -> Column:
    """A comparison on the bare column, which the file scan can evaluate itself."""
    c = ref(field)
    if isinstance(df.schema[field].dataType, T.IntegralType) and abs(x) < 2**62:
        if operator == "equals":
            return c == int(x) if x == int(x) else F.lit(False)
        return _COMPARE[operator](c, int(_WHOLE_LIMIT[operator](x)))
    hit = _COMPARE[operator](c, F.lit(x))
    # NaN and the infinities are no numbers; NaN sorts above +infinity
    if operator in ("gt", "gte"):
        return hit & (c < F.lit(float("inf")))
    if operator in ("lt", "lte"):
        return hit & (c > F.lit(float("-inf")))
    return hit


def numeric_predicate(df: DataFrame, cond: Condition) -> Column:
    if cond.operator == "isEmpty":
        return _empty_like(df, cond.field)
    if cond.operator == "isNotEmpty":
        return ~_empty_like(df, cond.field)
    typed = kind_of(df, cond.field) == KIND_NUMBER
    v = number_of(df, cond.field)

    def compare(operator: str, x: float) -> Column:
        return _typed_compare(df, cond.field, operator, x) if typed else _COMPARE[operator](v, x)

    if cond.operator == "between":
        bounds = between_bounds(cond)
        hit = compare("gte", bounds[0]) & compare("lte", bounds[1]) if bounds else F.lit(False)
    elif cond.operator in _COMPARE:
        x = literal_number(cond.value)
        hit = F.lit(False) if x is None else compare(cond.operator, x)
    else:
        # an unknown operator matches every numeric cell
        hit = v.isNotNull()
    return hit if typed else F.coalesce(hit, F.lit(False))


def text_predicate(df: DataFrame, cond: Condition) -> Column:
    if cond.operator == "isEmpty":
        return _empty_like(df, cond.field)
    if cond.operator == "isNotEmpty":
        return ~_empty_like(df, cond.field)
    t = normalize_cell(text_of(df, cond.field))
    wanted = F.lit(str(cond.value).strip(WHITESPACE))
    if cond.operator == "equals":
        return t == wanted
    if cond.operator == "contains":
        return F.contains(t, wanted)
    if cond.operator == "notContains":
        return ~F.contains(t, wanted)
    return F.lit(True)


def predicate(df: DataFrame, conditions: Sequence[Condition], numeric_fields: Collection[str]) -> Column:
    active = active_conditions(conditions)
    tests = [
        numeric_predicate(df, c) if c.field in numeric_fields else text_predicate(df, c)
        for c in active
    ]
    return reduce(and_, tests) if tests else F.lit(True)


def active_conditions(conditions: Sequence[Condition]) -> list[Condition]:
    return [c for c in conditions if c.field and c.operator]


def filter_rows(
    df: DataFrame, conditions: Sequence[Condition], numeric_fields: Collection[str] = (),
    on_empty: str = "empty",
) -> DataFrame:
    """Rows that meet every condition.  ``on_empty='keep'`` returns all rows when none does."""
    if not active_conditions(conditions):
        return df
    test = predicate(df, conditions, numeric_fields)
    if on_empty != "keep":
        return df.where(test)
    any_hit = df.agg(F.bool_or(test).alias("any")).scalar()
    return df.where(F.coalesce(test, F.lit(False)) | ~F.coalesce(any_hit, F.lit(False)))


def filter_summary(
    df: DataFrame, conditions: Sequence[Condition], numeric_fields: Collection[str] = ()
) -> DataFrame:
    """Rows before and after, share removed, number of active conditions; one pass."""
    test = predicate(df, conditions, numeric_fields)
    n = df.agg(F.count(F.lit(1)).alias("original_count"), F.count_if(test).alias("filtered_count"))
    removed = F.try_divide(F.col("original_count") - F.col("filtered_count"), F.col("original_count"))
    return n.select(
        "original_count", "filtered_count",
        F.coalesce(removed, F.lit(0.0)).alias("filter_ratio"),
        F.lit(len(active_conditions(conditions))).cast("bigint").alias("active_conditions"),
    )


def numeric_filterable(profile: DataFrame) -> DataFrame:
    """Which fields of a legacy profile take numeric conditions.

    Known metric roles do; identity fields and long unique digit strings do not;
    others when at least half of the cells are numbers.
    """
    identity = (F.col("role") == "identity") | (F.col("type") == "identity")
    code_like = (F.col("value_pattern") == "longNumber") & (F.col("unique_ratio") > 0.8)
    return profile.select(
        "field",
        F.when(F.col("role").isin(*NUMERIC_ROLES), True)
        .when(identity | code_like, False)
        .otherwise(F.col("numeric_ratio") >= 0.5)
        .alias("numeric_filterable"),
    )


def field_values(df: DataFrame, field: str, row_id: str = "_row_id") -> DataFrame:
    """``(row_id, value)`` of the cells that hold a number."""
    return df.select(F.col(row_id), number_of(df, field).alias("value")).where("value IS NOT NULL")


def extraction_counts(df: DataFrame, field: str) -> DataFrame:
    v = number_of(df, field)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(v).alias("valid_count"),
        (F.count(F.lit(1)) - F.count(v)).alias("invalid_count"),
    ).select(F.lit(field).alias("field"), "*")


def exclude_rows(df: DataFrame, excluded: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """All rows but the excluded ids."""
    return df.join(excluded.select(row_id), row_id, "left_anti")
