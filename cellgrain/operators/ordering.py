"""Distributed order statistics: cumulative counts, exact quantiles, row numbers.

A running total over a whole table has no natural partitioning key.  Here the
value axis is cut into ranges; a value's range depends on the value alone, so the
result is the same on every (re)computation, and totals per range are small
enough to be accumulated on their own.  Range limits come from a mergeable
quantile sketch: they only decide how evenly the work is spread, never the
result.  Equal values are merged into one weighted row first, so a value that
fills a third of the table costs one row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# Tables of at most this many rows may be ordered inside one task.
SINGLE_TASK_ROWS = 1_000_000
# Aimed rows per value range beyond that.
ROWS_PER_RANGE = 500_000
# Cut points are literals of the plan; beyond these ranges grow with the table, or with its shuffle partitions.
MAX_RANGES = 4096


_assumed: ContextVar[tuple[int, bool] | None] = ContextVar("assumed_rows", default=None)


@contextmanager
def assuming(rows: int, least: bool = False) -> Iterator[None]:
    """Plan every table for that many rows, as if ``rows`` were passed to each operator; nothing is counted.

    With ``least`` tables are counted, and larger ones are planned for their own rows.
    """
    token = _assumed.set((rows, least))
    try:
        yield
    finally:
        _assumed.reset(token)


def count_rows(df: DataFrame, rows: int | None = None) -> int:
    """Row count that bounds single-task work; a planning size that no result may show.

    Pass ``rows``, or plan inside :func:`assuming`, when the size is known; otherwise the table is counted.
    """
    if rows is not None:
        return rows
    assumed, least = _assumed.get() or (0, True)
    return max(assumed, df.count()) if least else assumed


def range_count(df: DataFrame, rows: int) -> int:
    """Ranges for that many rows: one per ROWS_PER_RANGE, up to MAX_RANGES or the session's shuffle partitions."""
    most = max(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(2, min(most, rows // ROWS_PER_RANGE + 1))


def range_limits(df: DataFrame, value: Column, rows: int) -> list[float]:
    """Increasing cut points between ranges, or none for a small table."""
    if rows <= SINGLE_TASK_ROWS:
        return []
    ranges = range_count(df, rows)
    at = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(value.cast("double"), at, ranges * 8).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def with_range(df: DataFrame, value: str, limits: Sequence[float], out: str = "_range") -> DataFrame:
    """Number of the value range each row falls in (0 when there are no limits)."""
    if not limits:
        return df.withColumn(out, F.lit(0.0))
    cut = Bucketizer(
        splits=[float("-inf"), *limits, float("inf")],
        inputCol=value, outputCol=out, handleInvalid="keep",
    )
    return cut.transform(df)


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct non-null values with the number of rows that hold them (``n_equal``)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.where(F.col(value).isNotNull())
        # -0.0 and 0.0 are one value
        .withColumn(value, F.col(value) + F.lit(0.0))
        .groupBy(*keys, value)
        .agg(n.cast("bigint").alias("n_equal"))
    )


def fixed(df: DataFrame) -> DataFrame:
    """Write a frame once, so that later reads see the same rows in the same partitions.

    Uses the session's ``spark.checkpoint.dir``; only a local session without one
    gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cellgrain-checkpoint-"))
    return df.checkpoint()


def cumulative_counts(
    counts: DataFrame, keys: Sequence[str], value: str, limits: Sequence[float] = (),
    written: bool = False,
) -> DataFrame:
    """Add ``n_below`` (rows with a smaller value) and ``n_total`` per key to value counts.

    With ``limits`` the counts are read twice, so they are written once first, unless
    the caller says they are ``written`` already.
    """
    keys = list(keys)
    if not limits:
        base = counts.withColumn("_range", F.lit(0))
        run = W.partitionBy(*keys, "_range").orderBy(value)
        whole = W.partitionBy(*keys, "_range")
        return (
            base.withColumn("n_below", F.sum("n_equal").over(run) - F.col("n_equal"))
            .withColumn("n_total", F.sum("n_equal").over(whole))
            .drop("_range")
        )
    ranged = with_range(counts if written else fixed(counts), value, limits)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("n_equal").alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    every = W.partitionBy(*(keys or [F.lit(0)]))
    offsets = totals.select(
        *keys,
        "_range",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(every).alias("n_total"),
    )
    run = W.partitionBy(*keys, "_range").orderBy(value)
    return (
        ranged.withColumn("_running", F.sum("n_equal").over(run) - F.col("n_equal"))
        .join(offsets, [*keys, "_range"])
        .withColumn("n_below", F.col("_offset") + F.col("_running"))
        .drop("_offset", "_running", "_range")
    )


def ranked_counts(counts: DataFrame, keys: Sequence[str], value: str, rows: int) -> DataFrame:
    """``cumulative_counts`` of many keys with values of any scale: one range partitioning by key and value for all.

    A partition holds a stretch of one key, or several whole keys; it is numbered when the sorted rows are written, and starts
    at what the partitions before it hold of the key. So the work does not depend on how many keys there are, and a key
    that holds most values is spread over as many partitions as it needs.
    """
    keys = list(keys)
    if rows <= SINGLE_TASK_ROWS:
        return cumulative_counts(counts, keys, value)
    placed = fixed(
        counts.repartitionByRange(range_count(counts, rows), *keys, value)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = placed.groupBy(*keys, "_part").agg(F.sum("n_equal").alias("_n"))
    before, every = W.partitionBy(*keys).orderBy("_part"), W.partitionBy(*keys)
    # a row per partition and key that it holds
    offsets = sums.select(
        *keys, "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"), F.sum("_n").over(every).alias("n_total")
    )
    run = W.partitionBy(*keys, "_part").orderBy(value)
    return (
        placed.withColumn("_running", F.sum("n_equal").over(run) - F.col("n_equal"))
        .join(offsets, [*keys, "_part"])
        .withColumn("n_below", F.col("_offset") + F.col("_running"))
        .drop("_offset", "_running", "_part")
    )


def _quantile_columns(names: Mapping[str, float], of: Column | None = None) -> list[Column]:
    """Linear interpolation at (n - 1) * q, read off a cumulative-count frame.

    ``of`` numbers the quantile a row was kept for, when rows differ per quantile.
    """
    out = []
    for i, (name, q) in enumerate(names.items()):
        pos = (F.col("n_total") - 1) * F.lit(float(q))
        base = F.floor(pos)
        v, lo, hi = F.col("_v"), F.col("n_below"), F.col("n_below") + F.col("n_equal")
        mine = F.lit(True) if of is None else of == i
        low = F.max(F.when(mine & (lo <= base) & (base < hi), v))
        high = F.max(F.when(mine & (lo <= base + 1) & (base + 1 < hi), v))
        rest = F.max(pos - base)
        out.append((low + rest * (F.coalesce(high, low) - low)).alias(name))
        if of is not None:
            whole = low.isNotNull() & (high.isNotNull() | (F.max(base) + 1 >= F.max("n_total")))
            out.append(whole.alias(f"_ok_{i}"))
    return out


# The quantile sketch is asked for ranks this far (as a share of the rows) to both
# sides of the wanted one: four times its own error bound.
SKETCH_ACCURACY = 10_000
BRACKET = 4 / SKETCH_ACCURACY
# Keys with at most this many numbers are left to the built-in ``percentile``.
WHOLE_KEY_ROWS = 10_000
# Most keys whose brackets are sent to every task.
MAX_BRACKET_KEYS = 100_000


def _narrowed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, float], aggs: Sequence[Column] = ()
) -> DataFrame | None:
    """Exact quantiles from the few values near each wanted rank, and ``aggs``; or None if that fails.

    For few keys with many rows.  A sketch per key brackets each rank, in the scan that works out ``aggs``.  The second scan counts the values below
    every bracket (one merged row) and keeps the distinct values inside it, so only
    about a thousandth of the column is shuffled.  The result is used only if every
    rank was found inside its bracket.
    """
    keys = list(keys)
    at = [min(1.0, max(0.0, q + d)) for q in names.values() for d in (-BRACKET, BRACKET)]
    rows = df.withColumn("_v", F.col(value) + F.lit(0.0))
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    # numbered when written, so that null keys meet like any other
    brackets = fixed(rows.groupBy(*keys).agg(
        *aggs, F.count("_v").alias("_n_total"), F.percentile_approx("_v", at, SKETCH_ACCURACY).alias("_b"),
    ).withColumn("_key", F.monotonically_increasing_id()))
    if brackets.count() > MAX_BRACKET_KEYS:
        return None
    bracket = F.broadcast(brackets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_key", "_b"))
    kept = []
    for i in range(len(names)):
        inside = F.when(F.col("_v") >= F.col("_b")[2 * i], F.col("_v"))
        kept.append(F.when(F.col("_v") <= F.col("_b")[2 * i + 1], F.struct(F.lit(i).alias("_i"), inside.alias("_v"))))
    near = rows.where(F.col("_v").isNotNull()).join(bracket, _same_keys(keys)).select(
        "_key", F.inline(F.filter(F.array(*kept), lambda s: s.isNotNull()))
    )
    counts = fixed(near.groupBy("_key", "_i", "_v").agg(F.count(F.lit(1)).alias("n_equal")))
    below = counts.where("_v IS NULL").select("_key", "_i", F.col("n_equal").alias("_before"))
    values = counts.where("_v IS NOT NULL")
    limits = range_limits(values, F.col("_v"), values.count())
    # one row per key and quantile on the small sides
    placed = (
        cumulative_counts(values, ["_key", "_i"], "_v", limits, written=True).drop("n_total")
        .join(F.broadcast(below), ["_key", "_i"], "left")
        .join(F.broadcast(brackets.select("_key", F.col("_n_total").alias("n_total"))), "_key")
        .withColumn("n_below", F.col("n_below") + F.coalesce("_before", F.lit(0)))
    )
    found = fixed(placed.groupBy("_key").agg(*_quantile_columns(names, F.col("_i"))))
    sound = F.lit(True)
    for i in range(len(names)):
        sound = sound & F.col(f"_ok_{i}")
    if not found.where(~sound).isEmpty():
        return None
    # a row per key on both sides; keys without a number keep their row
    return brackets.join(F.broadcast(found.select("_key", *names)), "_key", "left").drop("_n_total", "_b", "_key")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    names: Mapping[str, float],
    *,
    aggs: Sequence[Column] = (),
    weight: str | None = None,
    merged: bool = False,
    method: str = "exact",
    rows: int | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles per key, with further aggregates ``aggs`` of the same rows.

    Null values take no part in the quantiles; every key of ``df`` is kept, a null key too.
    In a table above ``SINGLE_TASK_ROWS`` rows the built-in ``percentile``, which keeps all distinct values of a key in
    one task, is used for keys of at most ``WHOLE_KEY_ROWS`` rows alone; for larger keys the wanted ranks are
    bracketed, or else all value ranges are counted through.  ``few_keys`` says that keys are few (columns, say), so that
    their sizes need no scan.
    ``method='approx'`` swaps in the bounded sketch.  ``weight`` names a row-count column;
    ``merged`` says that ``df`` holds one row per key and value and is cheap to read again.
    """
    keys = list(keys)
    rows = 0 if method == "approx" else count_rows(df, rows)

    def at_once(part: DataFrame) -> DataFrame:
        at = F.array(*[F.lit(float(q)) for q in names.values()])
        if method == "approx":
            packed = F.percentile_approx(F.col(value), at, 10_000)
        elif weight:
            packed = F.percentile(F.col(value), at, F.col(weight))
        else:
            packed = F.percentile(F.col(value), at)
        got = part.groupBy(*(keys or [F.lit(0).alias("_all")])).agg(*aggs, packed.alias("_q"))
        plain = [c for c in got.columns if c not in ("_q", "_all")]
        return got.select(*[F.col(f"`{c}`") for c in plain], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    def in_parts(part: DataFrame) -> DataFrame:
        found = None if weight else _narrowed_quantiles(part, keys, value, names, aggs)
        if found is not None:
            return found.drop("_all")
        found = _ranged_quantiles(part, keys, value, names, weight, merged, rows)
        others = part.groupBy(*(keys or [F.lit(0).alias("_all")])).agg(*aggs) if aggs else part.select(*keys).distinct()
        if not keys:
            return others.join(found, "_all", "left").drop("_all") if aggs else found.drop("_all")
        found = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        return others.join(found, _same_keys(keys), "left").drop(*[f"_k{i}" for i in range(len(keys))])

    if method == "approx" or rows <= SINGLE_TASK_ROWS:
        return at_once(df)
    if not keys or few_keys or weight:
        return in_parts(df)
    least = max(WHOLE_KEY_ROWS, rows // MAX_BRACKET_KEYS)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = fixed(sizes.where(F.col("_n") > least).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    n_large = large.count()
    if not n_large:
        return at_once(df)
    if n_large > MAX_BRACKET_KEYS:  # only if there are more rows than planned for
        return in_parts(df)
    large = F.broadcast(large)
    below = at_once(df.join(large, _same_keys(keys), "left_anti"))
    return below.unionByName(in_parts(df.join(large, _same_keys(keys), "left_semi")))


def _same_keys(keys: Sequence[str]) -> Column:
    """Each key equals its twin ``_k0``, ``_k1``, ..., nulls too."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def _ranged_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, float],
    weight: str | None, merged: bool, rows: int,
) -> DataFrame:
    """Exact quantiles by counting through all value ranges; works for any number of keys."""
    limits = range_limits(df, F.col(value), rows)
    if merged:
        counts = df.where(F.col(value).isNotNull()).select(
            *keys, F.col(value).alias("_v"), F.col(weight).alias("n_equal")
        )
    else:
        counts = value_counts(df, keys, value, weight).withColumnRenamed(value, "_v")
    ordered = cumulative_counts(counts, keys, "_v", limits, written=merged)
    return ordered.groupBy(*(keys or [F.lit(0).alias("_all")])).agg(*_quantile_columns(names))


# A value held by more than 1/HOT_SHARE of the rows, or by more than HOT_ROWS of them if that is less, counts as
# hot. There are never more than the larger of HOT_SHARE and rows / HOT_ROWS; HOT_MOST bounds what is broadcast.
HOT_SHARE = 1000
HOT_ROWS = 10_000_000
HOT_MOST = 100_000


def is_hot(n_equal: Column, total: Column) -> Column:
    """Whether so many rows of one value would make a heavy shuffle key."""
    least = F.greatest(F.least(total / HOT_SHARE, F.lit(float(HOT_ROWS))), total / HOT_MOST)
    return n_equal > least


def attach_by_value(
    df: DataFrame, value: Column, marks: DataFrame, mark: str, hot: Column, columns: Sequence[str]
) -> DataFrame:
    """Left-join per-value results (unique in ``mark``) to rows, without a hot shuffle key.

    ``hot`` flags the values of :func:`is_hot`: at most HOT_MOST of them, broadcast.  All other rows meet their value in a shuffle
    join; rows already answered travel under spread-out keys that match nothing.  The place is computed on both sides: a literal
    there would be folded into a mere condition, and all answered rows would meet under the null value.
    """
    picked = marks.withColumn("_is_hot", F.coalesce(hot, F.lit(False)))
    few = F.broadcast(picked.where("_is_hot").select(
        F.col(mark).alias("_hot_mark"), *[F.col(c).alias(f"_hot_{c}") for c in columns]
    ))
    many = picked.where("NOT _is_hot").select(
        F.col(mark).alias("_mark"), F.xxhash64(F.col(mark).cast("double")).alias("_mark_place"),
        *[F.col(c).alias(f"_cold_{c}") for c in columns],
    )
    keyed = df.withColumn("_value", value + F.lit(0.0))
    first = keyed.join(few, F.col("_value") == F.col("_hot_mark"), "left")
    done = F.col("_hot_mark").isNotNull() | F.col("_value").isNull()
    # content hash plus partition number: stable when a lost task is run again
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20))
    second = (
        first.withColumn("_place", F.when(done, spread).otherwise(F.xxhash64(F.col("_value").cast("double"))))
        .withColumn("_key", F.when(~done, F.col("_value")))
        .join(many, (F.col("_key") == F.col("_mark")) & (F.col("_place") == F.col("_mark_place")), "left")
    )
    return second.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns],
    )


def attach_by_keys(
    df: DataFrame, keys: Sequence[str], marks: DataFrame, hot: Column, columns: Sequence[str]
) -> DataFrame:
    """Rows of ``df`` with the ``columns`` of their mark, which is unique in ``keys``; rows without a mark go.

    ``hot`` flags marks that would make a heavy shuffle key; they are broadcast, so there must be few.
    """
    picked = marks.select(*keys, *columns, F.coalesce(hot, F.lit(False)).alias("_is_hot"))
    few = F.broadcast(picked.where("_is_hot").drop("_is_hot"))
    many = picked.where("NOT _is_hot").drop("_is_hot")
    keys = list(keys)
    others = df.join(few.select(*keys), keys, "left_anti")
    return df.join(few, keys).unionByName(others.join(many, keys))


def row_numbers(
    df: DataFrame, order: Sequence[str], out: str = "_row_id", rows: int | None = None
) -> DataFrame:
    """Contiguous 0-based row positions in the order of the given columns.

    A large table is range-sorted, fixed by a checkpoint, and each partition starts
    at the number of rows before it.  Ties go by a hash of the whole row, then by all
    columns that can be ordered, on both paths; so the numbers do not depend on the path, and rows
    that share one order value still spread over partitions.
    """
    rows = count_rows(df, rows)
    keyed = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    cols = [*order, "_tie", *plain]
    if rows <= SINGLE_TASK_ROWS:
        run = W.partitionBy(F.lit(0)).orderBy(*cols)
        return keyed.withColumn(out, (F.row_number().over(run) - 1).cast("bigint")).drop("_tie")
    parts = range_count(df, rows)
    placed = fixed(
        keyed.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    # monotonically_increasing_id holds the partition above bit 33, the local row below
    part = F.shiftright("_at", 33)
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part")
    offsets = sizes.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    # one row per partition, so at most MAX_RANGES rows
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + local).cast("bigint"))
        .drop("_part", "_offset", "_at")
    )
