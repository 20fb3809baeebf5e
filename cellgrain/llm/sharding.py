"""Sharding in Hilbert-curve order: shards whose files have narrow ranges in several metadata columns at once.

Each dimension is quantised into 2**bits cells of about equal row counts, the cells of a row give its position on
a Hilbert curve, rows are ranked by that position, and the order is cut into runs. A reader that filters on any
of the dimensions can skip most files by their minimum and maximum.

Law ``rows``: shard sizes differ by one row at most. Ranks are exact at any size: rows are range-partitioned by the
order, numbered inside their partition, and shifted by the row counts of the partitions before.

Defined results: nulls of a dimension form its lowest cell. Rows equal in the whole order take neighbouring ranks;
which of them comes first makes no difference to what can be read back. An empty table gives no rows. Fewer rows
than shards leave some shards empty. Texts take part by their columns only, so their length does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.llm.common import load, query, settle

_PREFIX_BYTES = 6


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits per axis; ``axes`` has one row per axis.

    After Skilling, "Programming the Hilbert curve" (2004), on whole columns: undo the excess work of each bit
    level from the top, Gray-decode across the axes, and interleave the bits.
    """
    x = axes.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            flips = (x[k] & q) != 0
            swap = np.where(flips, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flips, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | ((x[k] >> b) & 1)
    return out


def _ordinal(df: DataFrame, name: str, shared: str | None) -> Column:
    """An order-preserving number: strings by the six bytes after the prefix that all values share."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).cast("double")
    tail = F.col(name).cast("binary")
    tail = F.substring(tail, len((shared or "").encode()) + 1, _PREFIX_BYTES)
    return F.conv(F.rpad(F.hex(tail), 2 * _PREFIX_BYTES, "0"), 16, 10).cast("double")


def with_cells(df: DataFrame, dimensions: Sequence[str], bits: int) -> DataFrame:
    """Adds _cell0, _cell1, ... with 0 for null: the number of cut points at or below the value.

    Cut points are approximate quantiles over all rows, so a value that a third of the rows share takes one cell
    and the others keep their resolution. Two aggregates of a few rows.
    """
    texts = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    shared: dict[str, str] = {}
    if texts:
        ends = df.agg(*(f(d).alias(f"{k}{i}") for i, d in enumerate(texts) for k, f in (("a", F.min), ("b", F.max)))).first()
        for i, d in enumerate(texts):
            a, b = ends[f"a{i}"] or "", ends[f"b{i}"] or ""
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            shared[d] = a[:same]
    ordinals = {d: _ordinal(df, d, shared.get(d)) for d in dimensions}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(o, steps, 10_000).alias(f"q{i}") for i, o in enumerate(ordinals.values()))).first()
    cells = {}
    for i, ordinal in enumerate(ordinals.values()):
        # a cut point that fills several steps counts once; the lowest cell is left to nulls
        limits = sorted(set(cuts[f"q{i}"] or []))
        cell = sum((F.when(ordinal >= limit, 1).otherwise(0) for limit in limits[: (1 << bits) - 2]), F.lit(1))
        cells[f"_cell{i}"] = F.when(ordinal.isNull(), 0).otherwise(cell)
    return df.withColumns(cells)


def curve(df: DataFrame, dimensions: Sequence[str], bits: int = 5) -> DataFrame:
    """Adds ``hilbert``, the row's place on the curve through the cells of ``dimensions``."""

    @F.pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(dtype=np.int64).T, bits))

    names = [f"_cell{i}" for i in range(len(dimensions))]
    return with_cells(df, dimensions, bits).withColumn("hilbert", place(F.struct(*names))).drop(*names)


def ranked(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with an exact global ``rank`` from 0 by ``order``, and a one-row table with the total ``n_rows``."""
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = numbered.withColumn("_at", F.monotonically_increasing_id())  # partition number, then row number
    numbered = settle(
        numbered.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"),
        "ranked",
    )
    # one row per partition, so this small table may be summed in one task and broadcast
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    lists = counts.agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("s"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))
    offsets = lists.select(F.posexplode("s").alias("i", "p"), "s").select(
        F.col("p._part").alias("_part"),
        F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_before"),
    )
    out = numbered.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_row"))
    return out.drop("_part", "_row", "_before"), lists.select("n_rows")


def hilbert_shards(
    df: DataFrame, dimensions: Sequence[str], n_shards: int, tie_break: Sequence[str] = (), bits: int = 5
) -> DataFrame:
    """Adds hilbert, ``shard`` from 0 to n_shards - 1 and ``slot``, the row's place in its shard from 0.

    Pass only the columns that are wanted back: all of them travel in the sort. hilbert, shard and slot replace columns of
    those names; all others pass, whatever their names.
    """
    own = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    axes, order = [f"_axis{i}" for i in range(len(dimensions))], [f"_order{i}" for i in range(len(tie_break))]
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`").alias(c) for c in own)).alias("_own"),
        *(F.col(f"`{c}`").alias(n) for c, n in zip([*dimensions, *tie_break], axes + order, strict=True)),
    )
    out, total = ranked(curve(keyed, axes, bits), ["hilbert", *order])
    n = int(total.first()[0])
    out = out.withColumn("shard", F.expr(f"cast(rank * {n_shards}L div {max(n, 1)}L as int)"))
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")  # the least rank of the shard
    return out.withColumn("slot", F.col("rank") - first).select(*(F.col("_own").getField(c).alias(c) for c in own), "hilbert", "shard", "slot")


def write_shards(df: DataFrame, shards: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write all rows as Parquet, one folder per shard, given ``shards`` with their keys: one place for every row.

    Both sides are ranked by the keys and whatever else they share, and equal ranks meet, so null and repeated keys
    take as many places as they have rows, without a task that holds all rows of a key. Rows that the shared columns
    can't tell apart may take each other's places. Rows without a place, and places without a row, are an error.
    Range-partitioned by place, so a shard may have many files, each a run of the curve in order.
    """
    types = {f.name: f.dataType for f in shards.schema}
    shared = [
        f.name for f in df.schema if f.name not in ("hilbert", "shard", "slot", *keys)
        and types.get(f.name) == f.dataType and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)
    ]
    names = [*keys, *shared]
    own = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("_whole"), *(F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(names)),
        F.monotonically_increasing_id().alias("_own"),  # spreads the rows of a key over the range partitions
    )
    places = shards.select(*(F.col(f"`{c}`").alias(f"_to{i}") for i, c in enumerate(names)), "shard", "slot")
    rows, _ = ranked(rows, [*(f"_key{i}" for i in range(len(names))), "_own"])
    places, _ = ranked(places, [*(f"_to{i}" for i in range(len(names))), "shard", "slot"])
    met = F.col("_own").isNotNull() & F.col("shard").isNotNull()
    for i in range(len(names)):
        met = met & F.col(f"_key{i}").eqNullSafe(F.col(f"_to{i}"))
    placed = rows.join(places, "rank", "full").select(
        *(F.col("_whole").getField(c).alias(c) for c in own),
        F.when(met, F.col("shard")).otherwise(F.raise_error(F.lit("rows and their places in shards differ")).cast("int")).alias("shard"), "slot",
    )
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = hilbert_shards(
        docs, ["source", "lang", "n_chars"], 40, ["doc_id", "text_crc32", "size", "source", "lang", "n_chars"]
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
