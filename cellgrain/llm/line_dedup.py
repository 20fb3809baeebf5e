"""Line dedup: lines found in many documents are dropped, the others are put together again.

The lines of every whole text are exploded, normalised and hashed; documents are counted per hash, and the lines
of hashes at or over the threshold go. Hashes have 128 bits, so distinct lines do not meet at any table size.

Defined results: a null or empty text is one empty line. A row is a document: rows that repeat an id or a text
count separately. A line whose key has fewer than ``min_chars`` code points is never dropped. Other columns pass
unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import BLANK_CHARS, load, on_row_key, only, packed, query, row_key, settle, unpacked

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK_CHARS)), _UPPER, _LOWER)


def _hashed(lines: Column, min_chars: int) -> Column:
    def one(key: Column) -> Column:
        return F.when(
            F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
        )

    return F.transform(F.transform(lines, line_key), one)  # the key is made once, then used three times


def frequent_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (a, b) of the line keys that at least ``min_documents`` rows hold, with their count."""
    distinct = F.array_distinct(_hashed(lines_of(F.col("text")), min_chars))
    return (
        docs.select(F.explode(distinct).alias("h")).where("h IS NOT NULL")
        .groupBy("h.a", "h.b").agg(F.count(F.lit(1)).alias("n_documents"))
        .where(F.col("n_documents") >= min_documents)
    )


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with text replaced by its kept lines, and n_lines and n_dropped added.

    Two scans of the texts: one to count, one to mark. Marks are (row, position), merged per row before they
    meet the texts. The join with the frequent hashes is left to Spark, which broadcasts them only under its
    size threshold and splits skewed hashes otherwise.
    """
    frequent = settle(frequent_lines(docs, min_documents, min_chars).select("a", "b"), "frequent-lines")
    marks = (
        docs.select(*row_key(), F.posexplode(_hashed(lines_of(F.col("text")), min_chars)).alias("pos", "h"))
        .where("h IS NOT NULL").select("_id", "_text_hash", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .join(frequent, ["a", "b"])
        .groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    )
    key_id, key_hash = row_key()
    keyed = packed(docs).withColumns({"_id": key_id, "_text_hash": key_hash})
    joined = on_row_key(keyed, marks, "left").withColumns({
        "_lines": lines_of(F.col("text")), "_drop": F.coalesce("_drop", F.array().cast("array<int>")),
    })
    # the runs between dropped positions, one slice each
    cuts = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_lines")))
    kept = F.flatten(F.transform(
        F.slice(F.col("_cuts"), F.lit(1), F.size("_cuts") - 1),
        lambda at, i: F.slice(F.col("_lines"), at + 2, F.get(F.col("_cuts"), i + 1) - at - 1),
    ))
    out = (
        joined.withColumn("_cuts", cuts)
        .withColumns({
            "text": F.when(F.size("_drop") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")),
            "n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_drop").cast("long"),
        })
    )
    return unpacked(out, docs, "n_lines", "n_dropped")


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{_UPPER}', '{_LOWER}') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_lines(docs, min_documents=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
