"""Date parsing for text cells.  Every result is UTC, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrain.functions.text import WS_CLASS, trimmed

# Accepted date shapes.
_RE_YMD = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
_RE_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
_RE_YMD_DOT = r"^\d{4}\.\d{1,2}\.\d{1,2}$"
_RE_YMD_CJK = r"^(\d{4})年(\d{1,2})月(\d{1,2})日$"
_RE_MDY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_RE_YMD_HM = (
    rf"^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}[{WS_CLASS}T]+\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?$"
)

_DAY_MS = 86_400_000


def _midnight(ymd: Column) -> Column:
    """'Y-M-D' text to its UTC midnight in epoch ms; impossible days give null."""
    day = ymd.try_cast("date")
    # Two-digit years are not accepted, not even zero-padded ones.
    return F.when(F.year(day) >= 100, F.unix_date(day).cast("bigint") * F.lit(_DAY_MS))


def _instant(text: Column) -> Column:
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), text).otherwise(
        F.concat(text, F.lit("Z"))
    )
    return F.unix_millis(zoned.try_cast("timestamp"))


def wall_clock_ms(c: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    return (
        F.unix_date(c.cast("date")).cast("bigint") * F.lit(_DAY_MS)
        + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1000
        + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("bigint")
    )


def day_text(ms: Column) -> Column:
    """The UTC day of an epoch-millisecond value as yyyy-MM-dd."""
    return F.date_from_unix_date(F.floor(ms / F.lit(_DAY_MS)).cast("int")).cast("string")


def parse_date_ms(c: Column) -> Column:
    """Epoch milliseconds of ``Y-M-D``, ``Y/M/D`` or an ISO-8601 date-time, else null."""
    t = trimmed(c)
    return F.when(t.rlike(_RE_YMD), _midnight(F.translate(t, "/", "-"))).when(
        t.rlike(_RE_ISO), _instant(t)
    )


def parse_date(c: Column) -> Column:
    return F.timestamp_millis(parse_date_ms(c))


def temporal_ms(c: Column) -> Column:
    """Epoch milliseconds for the wider family of date shapes used in type detection.

    Beyond :func:`parse_date_ms`: ``Y.M.D``, ``Y年M月D日``, ``M/D/Y`` and
    ``Y-M-D H:MM[:SS]``.  The list is fixed, so results do not depend on a locale.
    """
    t = trimmed(c)
    cjk = F.regexp_replace(t, _RE_YMD_CJK, "$1-$2-$3")
    mdy = F.regexp_replace(t, _RE_MDY, "$3-$1-$2")
    stamp = F.regexp_replace(F.translate(t, "/", "-"), f"[{WS_CLASS}T]+", " ")
    stamp = F.when(stamp.rlike(r":\d{2}:"), stamp).otherwise(F.concat(stamp, F.lit(":00")))
    return (
        F.when(t.rlike(_RE_YMD), _midnight(F.translate(t, "/", "-")))
        .when(t.rlike(_RE_ISO), _instant(t))
        .when(t.rlike(_RE_YMD_DOT), _midnight(F.translate(t, ".", "-")))
        .when(t.rlike(_RE_YMD_CJK), _midnight(cjk))
        .when(t.rlike(_RE_MDY), _midnight(mdy))
        .when(t.rlike(_RE_YMD_HM), _instant(stamp))
    )


def is_temporal(c: Column) -> Column:
    return temporal_ms(c).isNotNull()
