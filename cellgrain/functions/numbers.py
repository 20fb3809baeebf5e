"""Dirty-cell number parsing and small numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrain.functions.text import WHITESPACE, WS_CLASS, trimmed

# Cells that mean "no value".
PLACEHOLDERS = ("-", "—", "–", "/", "\\", "|")

# Words that mark a cell as a status, not a number.
STATUS_WORDS = (
    "缺考", "弃考", "转班", "转到", "无", "无成绩",
    "休学", "退学", "请假", "缓考",
)

# Shapes that are dates and therefore never numbers.
RE_DATE_SHAPES = (
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
    r"|^\d{4}年\d{1,2}月\d{1,2}日?$"
    rf"|^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}[{WS_CLASS}]+\d{{1,2}}:\d{{2}}"
)

# A plain decimal/exponent literal or strict thousands groups, optionally with
# a percent sign.  No status word and no date shape can match it, so one regex
# decides validity.
_RE_NUMBER = (
    r"^[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    rf"(?:[{WS_CLASS}]*%)?$"
)
# Radix literals (0x.., 0o.., 0b..) up to 60 bits, which is exact in conv().
_RADIX = (
    (rf"^0[xX][0-9a-fA-F]{{1,15}}(?:[{WS_CLASS}]*%)?$", 16),
    (rf"^0[oO][0-7]{{1,20}}(?:[{WS_CLASS}]*%)?$", 8),
    (rf"^0[bB][01]{{1,60}}(?:[{WS_CLASS}]*%)?$", 2),
)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    """Double with NaN and infinities nulled (Spark sorts NaN above every number)."""
    d = c.cast("double")
    return F.when(is_finite(d), d)


def is_valid_percentile(c: Column) -> Column:
    return F.coalesce(is_finite(c) & c.between(0, 100), F.lit(False))


def is_empty_like(c: Column) -> Column:
    """Null, blank or a lone placeholder.  0 and status words are not empty."""
    t = trimmed(c)
    return c.isNull() | t.isin("", *PLACEHOLDERS)


def has_status_word(c: Column, words: Sequence[str] = STATUS_WORDS) -> Column:
    """Case-insensitive substring test against a word list."""
    low = F.lower(c)
    hits = [F.contains(low, F.lit(w.lower())) for w in words]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(False))


def is_date_shaped(c: Column) -> Column:
    return trimmed(c).rlike(RE_DATE_SHAPES)


def number(c: Column, status_words: Sequence[str] = STATUS_WORDS) -> Column:
    """The finite double a text cell stands for, else null.

    ``85%`` is 85; commas must be strict thousands groups; blanks, placeholders,
    status words and dates give null.
    """
    t = trimmed(c)
    plain = F.translate(t, ",%" + WHITESPACE, "").try_cast("double")
    value = F.when(t.rlike(_RE_NUMBER), F.when(F.abs(plain) < F.lit(float("inf")), plain))
    for pattern, base in _RADIX:
        digits = F.substring(F.translate(t, "%" + WHITESPACE, ""), 3, 64)
        value = value.when(t.rlike(pattern), F.conv(digits, base, 10).try_cast("double"))
    if tuple(status_words) != STATUS_WORDS:
        # Only a custom list can contain a word that also looks like a number.
        value = F.when(~has_status_word(t, status_words), value)
    return value


def number_status(c: Column, status_words: Sequence[str] = STATUS_WORDS) -> Column:
    """'empty', 'valid' or 'invalid'."""
    return (
        F.when(is_empty_like(c), "empty")
        .when(number(c, status_words).isNotNull(), "valid")
        .otherwise("invalid")
    )


def parse_number(c: Column, status_words: Sequence[str] = STATUS_WORDS) -> Column:
    """``struct<status:string, value:double>`` for a text cell."""
    return F.struct(
        number_status(c, status_words).alias("status"),
        number(c, status_words).alias("value"),
    )


def half_up(c: Column, digits: int) -> Column:
    """Round half towards +infinity; keeps the value when scaling overflows."""
    factor = 10.0**digits
    scaled = c * F.lit(factor)
    # Beyond 2**62 a double has no fraction left to round (and x * factor may be inf).
    return F.when(
        F.abs(scaled) < F.lit(2.0**62),
        F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(factor),
    ).otherwise(c)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(value - mean, std))


def normalize_score(score: Column, max_score: Column) -> Column:
    """score / max * 100; 0 when the maximum or either side is unusable."""
    ok = is_finite(score) & is_finite(max_score) & (max_score > 0)
    return F.when(ok, F.try_divide(score, max_score) * 100.0).otherwise(F.lit(0.0))
