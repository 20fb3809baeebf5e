"""Text normalisers and cell-shape predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that a spreadsheet-style trim removes.  Spark's
# own trim() only removes U+0020.
_WS_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
WHITESPACE = "".join(map(chr, _WS_CODE_POINTS))
# The same set as the body of a Java regex character class.
WS_CLASS = "".join(f"\\x{{{c:X}}}" for c in _WS_CODE_POINTS)

# Full-width forms U+FF01..U+FF5E sit exactly 0xFEE0 above their ASCII twins.
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

# Cell shapes.
RE_CHINESE_NAME = r"^[一-龥]{2,4}$"
RE_LONG_DIGITS = r"^\d{6,}$"
RE_ALL_DIGITS = r"^\d+$"
RE_CLASS_LABEL = "班|级|高一|高二|高三"
RE_CODE = r"^[0-9A-Za-z][0-9A-Za-z._\-]{2,29}$"
RE_COMPACT_DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{8}$"


def trimmed(c: Column) -> Column:
    """Strip every kind of blank (tabs, NBSP, ideographic space, BOM) at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_cell(c: Column) -> Column:
    """Raw-cell rule: a missing cell is '' and every cell is trimmed."""
    return F.coalesce(trimmed(c.cast("string")), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def to_half_width(c: Column) -> Column:
    return F.translate(c, _FULL_WIDTH, _HALF_WIDTH)


def loose(c: Column) -> Column:
    """Half width, lower case, trimmed, inner blanks squeezed to one space."""
    return F.regexp_replace(trimmed(F.lower(to_half_width(c))), f"[{WS_CLASS}]+", " ")


def compact(c: Column) -> Column:
    """``loose`` without blanks and common separators."""
    return F.regexp_replace(loose(c), rf"[{WS_CLASS}_\-./:：,，。·;；]+", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(to_half_width(c), r"\D+", "")


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; equal texts give 1, an empty side gives 0."""
    la, lb = F.length(a), F.length(b)
    return (
        F.when(a == b, F.lit(1.0))
        .when((la == 0) | (lb == 0), F.lit(0.0))
        .otherwise(1.0 - F.levenshtein(a, b) / F.greatest(la, lb))
    )


def is_chinese_name(c: Column) -> Column:
    return trimmed(c).rlike(RE_CHINESE_NAME)


def is_long_digits(c: Column) -> Column:
    return trimmed(c).rlike(RE_LONG_DIGITS)


def is_class_label(c: Column) -> Column:
    return trimmed(c).rlike(RE_CLASS_LABEL)


def is_code(c: Column) -> Column:
    return trimmed(c).rlike(RE_CODE)


def is_compact_date(c: Column) -> Column:
    return trimmed(c).rlike(RE_COMPACT_DATE)
