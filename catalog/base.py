"""Registration and the derived text columns that several queries share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.functions.numbers import half_up
from cellgrain.operators import ordering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, for files that a query writes and reads back."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="cellgrain-files-")
    return f"{held.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Doubles cut to a few decimals, so two engines agree on the last one."""
    return df.withColumns({n: half_up(F.col(n), digits) for n in names})


def r(expr: str, digits: int = 4) -> str:
    """The SQL twin of ``half_up``."""
    f = f"1e{digits}"
    return f"(floor(({expr}) * {f} + 0.5) / {f})"


# ---- dirty price text ---------------------------------------------------------
def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their price and date turned into messy text cells."""
    return load(spark, sf_dir, "orders").withColumns({"price_text": _price_text(), "date_text": _date_text()})


def _price_text() -> Column:
    return F.expr(
        """CASE o_orderkey % 11
             WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '缺考'
             WHEN 3 THEN concat(cast(floor(o_totalprice) AS string), '%')
             WHEN 4 THEN concat(cast(cast(floor(o_totalprice) AS int) div 1000 AS string), ',',
                                lpad(cast(cast(floor(o_totalprice) AS int) % 1000 AS string), 3, '0'))
             WHEN 5 THEN concat('  ', cast(floor(o_totalprice) AS string), ' ')
             WHEN 6 THEN NULL
             WHEN 7 THEN date_format(o_orderdate, 'yyyy-MM-dd')
             WHEN 8 THEN concat(cast(floor(o_totalprice) AS string), '分')
             ELSE cast(floor(o_totalprice) AS string) END"""
    )


PRICE_TEXT = """CASE o_orderkey % 11
             WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '缺考'
             WHEN 3 THEN concat(cast(cast(floor(o_totalprice) AS int) AS varchar), '%')
             WHEN 4 THEN concat(cast(cast(floor(o_totalprice) AS int) // 1000 AS varchar), ',',
                                lpad(cast(cast(floor(o_totalprice) AS int) % 1000 AS varchar), 3, '0'))
             WHEN 5 THEN concat('  ', cast(cast(floor(o_totalprice) AS int) AS varchar), ' ')
             WHEN 6 THEN NULL
             WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d')
             WHEN 8 THEN concat(cast(cast(floor(o_totalprice) AS int) AS varchar), '分')
             ELSE cast(cast(floor(o_totalprice) AS int) AS varchar) END"""


def _date_text() -> Column:
    return F.expr(
        """CASE o_orderkey % 7
             WHEN 0 THEN date_format(o_orderdate, 'yyyy/M/d')
             WHEN 1 THEN '2024-02-30'
             WHEN 2 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00Z')
             WHEN 3 THEN 'n/a'
             WHEN 4 THEN ''
             ELSE concat(' ', date_format(o_orderdate, 'yyyy-MM-dd')) END"""
    )


DATE_TEXT = """CASE o_orderkey % 7
             WHEN 0 THEN strftime(o_orderdate, '%Y/%-m/%-d')
             WHEN 1 THEN '2024-02-30'
             WHEN 2 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:30:00Z')
             WHEN 3 THEN 'n/a'
             WHEN 4 THEN ''
             ELSE concat(' ', strftime(o_orderdate, '%Y-%m-%d')) END"""

DIRTY = f"d AS (SELECT *, {PRICE_TEXT} AS price_text, {DATE_TEXT} AS date_text FROM orders)"

_NUM = (
    r"[+-]?(\d{1,3}(,\d{3})+(\.\d+)?|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*%?"
)


def sql_num(c: str) -> str:
    return (
        f"(CASE WHEN regexp_full_match(trim({c}), '{_NUM}') "
        f"THEN try_cast(replace(replace(trim({c}), ',', ''), '%', '') AS double) END)"
    )


def sql_empty(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) IN ('', '-', '—', '–', '/', '\\', '|'))"


def sql_status(c: str) -> str:
    return (
        f"(CASE WHEN {sql_empty(c)} THEN 'empty' WHEN {sql_num(c)} IS NOT NULL THEN 'valid' "
        f"ELSE 'invalid' END)"
    )


def sql_date_ms(c: str) -> str:
    day = (
        f"coalesce(try_strptime(trim({c}), '%Y-%m-%d'), try_strptime(trim({c}), '%Y/%m/%d'))"
    )
    iso = f"try_strptime(trim({c}), '%Y-%m-%dT%H:%M:%SZ')"
    return f"epoch_ms(coalesce({day}, {iso}))"


def sql_text(column: str, kind: str) -> str:
    """Cell text of a typed column."""
    if kind == "double":
        return (
            f"(CASE WHEN floor({column}) = {column} THEN cast(cast({column} AS bigint) AS varchar) "
            f"ELSE cast({column} AS varchar) END)"
        )
    return f"cast({column} AS varchar)"


def sql_unpivot(table: str, fields: Sequence[str], extra: str = "") -> str:
    """``(field, value, extra)`` of numeric columns."""
    more = f", {extra}" if extra else ""
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, cast({f} AS double) AS value{more} FROM {table}" for f in fields
    )


def at_scale(name: str, rows: int = 2_000_000) -> None:
    """Register ``<name>_at_scale``: the query as planned for tables of that many rows, or of their own where they have more."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with ordering.assuming(rows, least=True):
            return QUERIES[name](spark, sf_dir)

    QUERIES[f"{name}_at_scale"] = run
    ORACLES[f"{name}_at_scale"] = ORACLES[name]
