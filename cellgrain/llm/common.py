"""Registration and the few helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Inside a Java or Python pattern: the white space that ends a word.
BLANK = r"\x20\x09-\x0D"
#: The same as characters, for trimming.
BLANK_CHARS = " \t\n\x0b\x0c\r"

_OWN: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that join_spread deals over several tasks, at most; each has more than a MAX_HOT-th of all rows.
MAX_HOT = 5_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a local master may run without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN or not os.path.isdir(_OWN[0]):
        _OWN[:] = [tempfile.mkdtemp(prefix="cellgrain-llm-")]
    return f"file://{_OWN[0]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and lost executors cost no recomputation.

    The shuffle files behind it are removed with the end of the write. ``release`` removes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables. Their successor must be settled already: a plan that still reads them would fail."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, _PATHS.pop(table)
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_spread(many: DataFrame, one: DataFrame, keys: Sequence[str], times: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Inner join of ``many`` rows per key with ``one`` row per key, so that no task gets all rows of a hot key.

    ``times`` (keys, times) holds the rows of ``many`` per key. A key with more than a ``MAX_HOT``-th of them is cut
    into parts by the columns ``spread``, its row of ``one`` copied to each part. So there are under MAX_HOT such keys, and
    under twice as many copies: those alone are broadcast.
    """
    keys = list(keys)
    limit = times.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("s")).first()["s"] // MAX_HOT + 1
    hot = F.broadcast(times.where(F.col("times") > limit).select(*keys, F.ceil(F.col("times") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copied = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"]).drop("_part")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row: its id and a hash of its text, so rows that share an id stay apart.

    Rows equal in both are copies of each other and get equal results. Ids are whole numbers, or null; those of
    another type are cast, and a text that is no number is an error.
    """
    return [F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash")]


def on_row_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``_id`` and ``_text_hash``; a null id meets a null id. The right side's key columns go."""
    right = right.withColumnsRenamed({"_id": "_right_id", "_text_hash": "_right_hash"})
    held = (F.col("_id").eqNullSafe(F.col("_right_id"))) & (F.col("_text_hash") == F.col("_right_hash"))
    return left.join(right, held, how).drop("_right_id", "_right_hash")  # absent after a semi or anti join


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else a table brings along."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def packed_schema(docs: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    """Schema of doc_id, text, _row and further columns, for what a Python function makes of ``packed`` rows."""
    fields = [docs.schema[c] for c in ("doc_id", "text", "_row")]
    return T.StructType([*fields, *(T.StructField(n, t) for n, t in added)])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as ``_row``, so that no name can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in others)) if others else F.lit(None).cast("int")
    return docs.select("doc_id", "text", row.alias("_row"))


def unpacked(df: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of ``docs`` in their order, and ``added`` ones in place of any of the same name."""
    own = [c for c in docs.columns if c not in added]
    return df.select(*(
        F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in own
    ), *added)
