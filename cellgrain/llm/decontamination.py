"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity, so a signature of fixed length would miss it.
Both sides are therefore partitioned by size. A document with up to 2**c distinct shingles gets a one-permutation
MinHash signature of 2**(c + extra) bins, as many as its size asks for; an item is put into the same number of
bins. ``extra`` is chosen per item size, so that the chance that an item contained to the threshold meets its
document in no bin stays below ``miss``; from the threshold and the item's size that chance is
(1 - (1 - exp(-load)) / load) ** shared, with load = 2**-extra shingles to a bin. Where no bin count reaches it,
every shingle is kept, and the search is exact.

Pairs that meet in a bin are candidates. Each is verified on the texts: shared distinct shingles of the item over
all of its shingles. DataFrame functions only.

Defined results: words are runs of letters, marks and digits of the lower-cased text, a shingle is five of them.
A null or empty document contains nothing. Items of fewer than five words have no shingle and match nothing.
Repeated documents or items give one row per distinct pair. Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import load, on_row_key, only, packed, query, row_key, settle, unpacked

SHINGLE = 5
#: Item shingles up to which their table is broadcast (about 40 bytes each); larger ones meet by a shuffle.
BROADCAST_SHINGLES = 500_000
_ALL = 62


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1), "")


def _shingle_hashes(words: str, hashes: str) -> Column:
    """Distinct shingle hashes in ascending order; ``hashes`` holds the word hashes."""
    wide = F.transform(
        F.col(hashes), lambda h, i: F.xxhash64(h, *(F.get(F.col(hashes), i + k) for k in range(1, SHINGLE)))
    )
    return F.array_sort(F.array_distinct(F.slice(wide, F.lit(1), F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0)))))


def with_minima(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _sorted, the ordered distinct shingle hashes of the text.

    The top e bits of a hash are its bin among 2**e, so bins are runs of the order and a hash is its bin's minimum
    exactly where it differs in those bits from the hash before it, at every e at once.
    """
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_sorted", _shingle_hashes("_words", "_hashes")).drop("_hashes")


def _steps(sorted_hashes: str) -> Column:
    """(hash, its difference from the one before) of an ordered array; the first differs in all bits."""
    return F.transform(
        F.col(sorted_hashes),
        lambda h, i: F.struct(
            h.alias("h"), F.when(i == 0, F.lit(-1).cast("long")).otherwise(h.bitwiseXOR(F.get(sorted_hashes, i - 1))).alias("x")
        ),
    )


def _is_minimum(x: Column, e: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, (64 - e).cast("int")) != 0


def extra_bits(n_shingles: int, threshold: float, miss: float) -> int:
    """Bits of bins beyond the document's size, for items of that many shingles."""
    shared = math.ceil(threshold * n_shingles - 1e-9)
    for extra in range(-6, 13):
        load = 2.0 ** -extra
        if (1 - (1 - math.exp(-load)) / load) ** shared <= miss:
            return extra
    return _ALL


def _bits(size_class: Column, extra: Column) -> Column:
    return F.least(F.greatest(size_class + extra, F.lit(1)), F.lit(_ALL))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items with their ordered shingle hashes and the shingles themselves, framed by blanks."""
    items = with_minima(only(benchmark, "item_id", "text").where("text IS NOT NULL").dropDuplicates())
    items = items.where(F.size("_sorted") > 0)
    shingles = F.array_distinct(F.transform(
        F.slice("_words", F.lit(1), F.size("_words") - (SHINGLE - 1)),
        lambda w, i: F.concat(F.lit(" "), F.array_join(F.slice(F.col("_words"), i + 1, F.lit(SHINGLE)), " "), F.lit(" ")),
    ))
    return settle(
        items.select("item_id", F.xxhash64("text").alias("item_hash"), "_sorted", shingles.alias("shingles")), "benchmark-items"
    )


def candidates(docs: DataFrame, items: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(_id, _text_hash, item_id, item_hash) of pairs that meet in a bin."""
    sizes = [r[0] for r in items.select(F.size("_sorted").alias("n")).groupBy(F.expr("length(bin(n))").alias("c")).agg(F.min("n").alias("n")).select("n").collect()]
    # one partition of items per power of two; its smallest item decides
    extras = {n.bit_length(): extra_bits(n, threshold, miss) for n in sizes}
    size_class = F.length(F.bin(F.size("_sorted").cast("long")))
    extra = F.coalesce(*(F.when(size_class == c, F.lit(e)) for c, e in sorted(extras.items())), F.lit(_ALL))
    sketch = items.select("item_id", "item_hash", extra.alias("extra"), F.explode(_steps("_sorted")).alias("s"))
    sketch = sketch.select("item_id", "item_hash", "extra", F.col("s.h").alias("h"), F.col("s.x").alias("item_x"))
    if sketch.count() <= BROADCAST_SHINGLES:
        sketch = F.broadcast(sketch)
    finest = max(extras.values(), default=0)
    docs = with_minima(docs.select(*row_key(), "text")).withColumn("c", size_class)
    docs = docs.withColumn("e", _bits(F.col("c"), F.lit(finest)))
    minima = F.filter(_steps("_sorted"), lambda s: _is_minimum(s["x"], F.col("e")))
    signature = docs.select("_id", "_text_hash", "c", F.explode(minima).alias("s"))
    signature = signature.select("_id", "_text_hash", "c", F.col("s.h").alias("h"), F.col("s.x").alias("x"))
    bits = _bits(F.col("c"), F.col("extra"))
    return (
        signature.join(sketch, "h")
        .where(_is_minimum(F.col("x"), bits) & _is_minimum(F.col("item_x"), bits))
        .select("_id", "_text_hash", "item_id", "item_hash").distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, miss: float = 1e-9) -> DataFrame:
    """One row per document row and item contained in it: _id, _text_hash, item_id, n_shared, n_item, containment."""
    items = items_of(benchmark)
    # written, so that its size is known: a small table is broadcast, and the texts stay where they are
    found = settle(candidates(docs, items, threshold, miss), "contamination-candidates")
    pairs = on_row_key(docs.select(*row_key(), "text"), found, "inner").join(
        items.select(F.col("item_id").alias("_item"), F.col("item_hash").alias("_item_hash"), "shingles"),
        F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash")),
    )
    pairs = pairs.withColumn("_plain", F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" ")))
    pairs = pairs.select(
        "_id", "_text_hash", "item_id", F.size("shingles").cast("long").alias("n_item"),
        # named twice, so that the optimizer does not put its making into the loop
        F.when(F.col("_plain") == "  ", 0).otherwise(
            F.size(F.filter("shingles", lambda s: F.contains(F.col("_plain"), s)))
        ).cast("long").alias("n_shared"),
    )
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    return pairs.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    hits = settle(contamination(docs, benchmark, threshold).select("_id", "_text_hash").distinct(), "contaminated")
    key_id, key_hash = row_key()
    keyed = packed(docs).withColumns({"_id": key_id, "_text_hash": key_hash})
    return unpacked(on_row_key(keyed, hits, "left_anti"), docs)


_SQL_WORDS = r"[x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+') IF x <> '']"
SQL = f"""
WITH i AS (
  SELECT DISTINCT item_id, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s
  FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) >= 5
), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s
  FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents) WHERE len(w) >= 5
), p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM p JOIN n USING (item_id) WHERE n_shared / n_item >= 0.8
"""


@query("op8_decontamination", SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    return contamination(docs, load(spark, sf_dir, "benchmark")).select(
        F.col("_id").alias("doc_id"), "item_id", "n_shared", "n_item", "containment"
    )
