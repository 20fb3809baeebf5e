"""Finding records by a typed-in value."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrain.functions import text
from cellgrain.functions.text import WHITESPACE
from cellgrain.operators.cells import number_of, ref, text_of

_HALF = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}


def _half_width(s: str) -> str:
    return s.translate(_HALF)


def _loose(s: str) -> str:
    return re.sub(f"[{WHITESPACE}]+", " ", _half_width(s).lower().strip(WHITESPACE))


def compact_literal(s: str) -> str:
    """The plan-time twin of :func:`cellgrain.functions.text.compact`."""
    return re.sub(f"[{WHITESPACE}_\\-./:：,，。·;；]+", "", _loose(s))


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]+", "", _half_width(s))


def matches(
    df: DataFrame, field: str, query: str, semantic: str = "other", allow_clean: bool = False
) -> Column:
    """Whether a cell stands for the query: loose or compact equality, digits for times and ids."""
    if not query:
        return F.lit(False)
    cell = text.trimmed(text_of(df, field))
    hit = (text.loose(cell) == _loose(query)) | (text.compact(cell) == compact_literal(query))
    wanted = _digits(query)
    if semantic == "time" or (semantic == "identifier" and len(wanted) >= 6):
        hit = hit | (text.digits_only(cell) == wanted)
    if allow_clean:
        squeezed = re.sub(f"[{WHITESPACE}]+", "", _loose(query))
        hit = hit | (F.regexp_replace(text.loose(cell), f"[{text.WS_CLASS}]+", "") == squeezed)
    return F.coalesce((cell != "") & hit, F.lit(False))


def lookup(
    df: DataFrame, field: str, query: str, semantic: str = "other", allow_clean: bool = False
) -> DataFrame:
    return df.where(matches(df, field, query, semantic, allow_clean))


def lookup_combo(
    df: DataFrame, values: Mapping[str, str], semantics: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows that match every non-blank (field, value) pair; all rows when none is given."""
    active = {f: v for f, v in values.items() if v.strip(WHITESPACE)}
    semantics = semantics or {}
    tests = [matches(df, f, v, semantics.get(f, "other")) for f, v in active.items()]
    return df.where(reduce(and_, tests)) if tests else df


def _keys(cell: Column, semantic: str, asked: bool, digitless: bool) -> Column:
    """What a cell or query may be found under: its compact form and, by the rule of :func:`matches`, its digits."""
    compact = F.concat(F.lit("c"), text.compact(cell))
    if semantic not in ("time", "identifier"):
        return F.array(compact)
    digits = text.digits_only(cell)
    least = 6 if asked and semantic != "time" else 0 if digitless else 1
    ruled = F.length(digits) >= least
    return F.filter(F.array(compact, F.when(ruled, F.concat(F.lit("d"), digits))), lambda k: k.isNotNull())


def lookup_many(
    df: DataFrame, field: str, queries: DataFrame, query: str = "query", semantic: str = "other", digitless: bool = False
) -> DataFrame:
    """Many queries at once, each as :func:`lookup` answers it: an equality join on the keys of both sides.

    A pair that shares both keys comes once.  Spark splits the partitions of a frequent key where the join is skewed.
    :func:`lookup` lets a time without digits match every cell without digits.  Here that would pair all such queries with all
    such cells, so it is done only if ``digitless`` asks for it; their compact forms still match.
    """
    cell = text.trimmed(text_of(df, field))
    keyed = df.withColumn("_compact", text.compact(cell)).withColumn("_key", F.explode(_keys(cell, semantic, False, digitless))).where(cell != "")
    asked = queries.where(F.coalesce(F.col(query), F.lit("")) != "").withColumn("_asked", text.compact(F.col(query)))
    asked = asked.withColumn("_key", F.explode(_keys(F.col(query), semantic, True, digitless)))
    once = F.startswith("_key", F.lit("c")) | (F.col("_compact") != F.col("_asked"))
    return asked.join(keyed, "_key").where(once).drop("_key", "_compact", "_asked")


def lookup_cascade(
    df: DataFrame, query: str, *, id_field: str | None = None,
    candidates: Sequence[tuple[str, str]] = (), others: Sequence[str] = (),
    time_field: str | None = None,
) -> DataFrame:
    """Rows of the first stage that finds something, with its number and field.

    Stages: the unique id field, the candidates in the given order, every other
    column (only when it hits exactly one row), the time field by its digits.  All
    stages are counted in one aggregate; the winner is a scalar in the filter.
    """
    stages: list[tuple[str, Column, bool]] = []
    if id_field:
        stages.append((id_field, matches(df, id_field, query, "identifier"), False))
    stages += [(f, matches(df, f, query, s), False) for f, s in candidates]
    known = {f for f, _ in candidates}
    stages += [(f, matches(df, f, query, "other"), True) for f in others if f not in known]
    if time_field:
        wanted = _digits(query)
        cell = text.digits_only(text.trimmed(text_of(df, time_field)))
        hit = F.coalesce(cell == wanted, F.lit(False)) if wanted else F.lit(False)
        stages.append((time_field, hit, False))
    counts = df.agg(*[F.count_if(hit).alias(f"n{k}") for k, (_, hit, _) in enumerate(stages)])
    winner = F.lit(None).cast("int")
    for k, (_, _, single) in reversed(list(enumerate(stages))):
        n = F.col(f"n{k}")
        winner = F.when((n == 1) if single else (n > 0), F.lit(k)).otherwise(winner)
    first = counts.select(winner.alias("stage")).scalar()
    hit = F.lit(False)
    for k, (_, test, _) in enumerate(stages):
        hit = hit | ((F.col("_stage") == k) & test)
    names = F.array(*[F.lit(f) for f, _, _ in stages])
    return (
        df.withColumn("_stage", first).where(hit)
        .withColumn("stage", F.col("_stage") + 1)
        .withColumn("stage_field", F.element_at(names, F.col("stage")))
        .drop("_stage")
    )


def fill_values(matched: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Numbers of the chosen fields of matched records, and which of them are blank."""
    blanks = F.array(*[
        F.when(F.coalesce(text_of(matched, f), F.lit("")) == "", F.lit(f)) for f in fields
    ])
    keep = [c for c in matched.columns if c not in fields]
    return matched.select(
        *[ref(c) for c in keep],
        *[number_of(matched, f).alias(f) for f in fields],
        F.array_compact(blanks).alias("empty_fields"),
    )
