"""Reading delimited text into all-string tables, with ragged rows set aside."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.functions.text import WHITESPACE, WS_CLASS, normalize_cell, trimmed

# Routes of a record after the width check.
OK, SHORT, TOO_WIDE, OPEN_QUOTE = "ok", "short", "too_wide", "open_quote"

_NO_SEPARATOR = "\x02\x03\x02\x04"
_CONTROL = re.compile("[\x00-\x1f\x7f\xa0]")


def clean_header(raw: str) -> str:
    cleaned = _CONTROL.sub("", raw).strip(WHITESPACE)
    return re.sub(f"[{WHITESPACE}]{{2,}}", " ", cleaned).strip(WHITESPACE)


def clean_headers(raw: Sequence[str]) -> list[str]:
    """Tidy names; blanks get a running name, duplicates (any case) a suffix until unique."""
    out: list[str] = []
    seen: set[str] = set()
    blanks = 0
    for name in raw:
        base = clean_header(name)
        if not base:
            blanks += 1
            base = f"未命名字段{blanks}"
        candidate, k = base, 0
        while candidate.lower() in seen:
            k += 1
            candidate = f"{base}_{k}"
        seen.add(candidate.lower())
        out.append(candidate)
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_headers(df.columns))


def normalize_cells(df: DataFrame) -> DataFrame:
    """Every cell as trimmed text, missing cells as ''."""
    return df.select(*[normalize_cell(F.col(f"`{c}`")).alias(c) for c in df.columns])


def split_cells(line: Column, delimiter: str = "comma") -> Column:
    """Cells of one record: 'comma' honours quotes, 'tab' and 'multi-space' split plainly."""
    if delimiter == "tab":
        parts = F.split(line, "\t")
    elif delimiter == "multi-space":
        parts = F.split(line, f"[{WS_CLASS}]{{2,}}")
    elif delimiter == "comma":
        # A cell is a quoted run ("" inside stands for one quote) or plain text. Possessive, so that a long cell
        # takes no stack.
        pieces = F.regexp_extract_all(
            F.concat(F.lit(","), line), F.lit(r',((?:"(?:[^"]++|"")*+")?[^,]*)'), F.lit(1)
        )
        parts = F.transform(
            pieces,
            lambda p: F.when(
                F.startswith(p, F.lit('"')),
                F.replace(
                    F.regexp_replace(p, r'(?s)^"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"')
                ),
            ).otherwise(p),
        )
    else:
        raise ValueError(f"unknown delimiter {delimiter!r}")
    return F.transform(parts, trimmed)


def _has_open_quote(line: Column) -> Column:
    return F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1


@dataclass(frozen=True)
class Split:
    """A table cut into usable rows, set-aside records and counts per route."""

    rows: DataFrame
    quarantine: DataFrame
    counts: DataFrame


def _routed(df: DataFrame, line: Column, cells: Column, width: int, quoted: bool) -> DataFrame:
    n = F.size(cells)
    extra = F.slice(cells, width + 1, F.greatest(n - width, F.lit(0)))
    wide = (n > width) & F.exists(extra, lambda c: c != "")
    some = F.exists(cells, lambda c: c != "")
    route = F.when(wide, TOO_WIDE).when((n < width) & some, SHORT).otherwise(OK)
    if quoted:
        route = F.when(_has_open_quote(line), OPEN_QUOTE).otherwise(route)
    return df.withColumn("_route", route)


def route_records(
    lines: DataFrame, headers: Sequence[str], delimiter: str = "comma", line: str = "value"
) -> Split:
    """Check every record's width against the header.

    Non-empty surplus cells and unclosed quotes set a record aside; missing tail
    cells become '' and are counted; surplus blanks are ignored.
    """
    names = clean_headers(headers)
    keep = [c for c in lines.columns if c != line]
    split = lines.withColumn("_cells", split_cells(F.col(line), delimiter))
    routed = _routed(split, F.col(line), F.col("_cells"), len(names), delimiter == "comma")
    good = routed.where(F.col("_route").isin(OK, SHORT)).select(
        *keep,
        *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)],
    )
    bad = routed.where(F.col("_route").isin(TOO_WIDE, OPEN_QUOTE)).select(
        *keep, F.col(line), F.col("_route").alias("route"), F.size("_cells").alias("cells")
    )
    counts = routed.groupBy(F.col("_route").alias("route")).agg(F.count(F.lit(1)).alias("records"))
    return Split(good, bad, counts)


def read_lines(
    spark: SparkSession, path: str | list[str], headers: Sequence[str] | None = None,
    delimiter: str = "tab",
) -> Split:
    """A tab or multi-space text table; blank lines are no records.

    Without ``headers`` the first line of the first file names the columns, and the first line of every file is
    skipped, by its place and not by its text.
    """
    if headers is None:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        if first is None:
            raise ValueError("the file is empty")
        pattern = "\t" if delimiter == "tab" else f"[{WHITESPACE}]{{2,}}"
        headers = re.split(pattern, first["value"].lstrip("\ufeff"))
        # Spark's own csv reader skips the head of each file; with this separator and no quotes a line is one cell
        lines = spark.read.options(sep=_NO_SEPARATOR, quote="", header=True, enforceSchema=True).csv(path, schema="value string")
    else:
        lines = spark.read.text(path)
    return route_records(lines.where(F.trim("value") != ""), headers, delimiter)


def read_csv(
    spark: SparkSession, path: str | list[str], headers: Sequence[str] | None = None,
    multi_line: bool = True, encoding: str = "UTF-8",
) -> Split:
    """A comma-separated table as text columns.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per
    file; switch it off for large files without such cells, which are then split.
    """
    reader = spark.read.options(
        sep=",", quote='"', escape='"', multiLine=multi_line, encoding=encoding, mode="PERMISSIVE",
        # the width check needs every cell, whatever is selected later
        columnPruning=False,
    )
    has_header = headers is None
    if headers is None:
        headers = reader.csv(path, header=True, inferSchema=False).columns
    names = clean_headers(headers)
    schema = ", ".join(f"`{c}` string" for c in [*names, "_corrupt"])
    raw = reader.csv(
        path, schema=schema, header=has_header, enforceSchema=True, columnNameOfCorruptRecord="_corrupt"
    )
    # Records of the wrong width arrive with their full text; only those are split again.
    typed = F.array(*[normalize_cell(F.col(f"`{c}`")) for c in names])
    cells = F.when(F.col("_corrupt").isNotNull(), split_cells(F.col("_corrupt"))).otherwise(typed)
    split = raw.withColumn("_cells", cells)
    record = F.coalesce("_corrupt", F.lit(""))
    routed = _routed(split, record, F.col("_cells"), len(names), True)
    good = routed.where(F.col("_route").isin(OK, SHORT)).select(
        *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)]
    )
    bad = routed.where(F.col("_route").isin(TOO_WIDE, OPEN_QUOTE)).select(
        F.col("_corrupt").alias("value"), F.col("_route").alias("route"), F.size("_cells").alias("cells")
    )
    counts = routed.groupBy(F.col("_route").alias("route")).agg(F.count(F.lit(1)).alias("records"))
    return Split(good, bad, counts)
