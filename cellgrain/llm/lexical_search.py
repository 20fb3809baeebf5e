"""Ranked lexical search: dense blocked products of item vocabulary tiles and document impact tiles.

The items are dealt into blocks of a bounded number of terms, and every block meets every document once:

1. One scan of the texts keeps, per document, its number of terms and its counts of the block's terms. Those small
   rows are written; corpus size, length and the document frequency of each term come from them.
2. Items are tiled, ``TILE_ITEMS`` at a time, and each tile has a compact vocabulary of its own. A slice of documents
   becomes a dense matrix of impacts (documents x tile vocabulary), the tile one of weights (vocabulary x items), both
   float64 with whole numbers only, and BLAS multiplies them. A product is summed over at most as many terms as keep every
   partial sum below 2**53, whatever order BLAS adds in; the sums of such strips are added as 64-bit integers. So scores are exact.
3. Each task keeps the k best documents of each item, ties to the lesser id, and Spark ranks what the tasks kept.

The scoring: with N documents that hold a term, L terms in all, n terms in the document and document frequency df,
weight = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, impact = (10**9 tf) div (1000 tf + 8 m);
the score sums weight x impact over the item's distinct terms.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A null text has
none. Documents that share no term with an item, or only terms of weight 0, are not ranked for it; so an item
without terms, or one with a null text, has no rows. A document is a row: repeated rows are ranked each. Ids are
numbers; a null id ranks before others of equal score. Rows that repeat an item's id and text are one item; rows that
share an id and differ in text are ranked apart. Texts of any length are taken whole. Other columns are left
out. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrain.llm import wordhash
from cellgrain.llm.common import load, only, query, settle
from cellgrain.llm.tokens import byte_class, coded

_TERM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Distinct terms of a block of items, on average; what a block holds goes to every task and, with a count each, to the driver.
BLOCK_TERMS = 500_000
#: Items multiplied together, entries of an impact tile (8 bytes each) and the largest whole number that float64 adds exactly.
TILE_ITEMS, TILE_CELLS, EXACT = 32, 4 << 20, 2**53
#: Bytes of text that are split into terms together.
SLICE = 4 << 20


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [[] for _ in range(batch.num_rows)]
        w = coded(batch.column("text"), _TERM)
        spelled = w.words.to_pylist()
        for row, code in sorted(set(zip(w.row.tolist(), w.code.tolist(), strict=True))):
            terms[row].append(spelled[code].decode())
        yield pa.RecordBatch.from_pydict({
            "item_id": batch.column("item_id"), "item_hash": batch.column("item_hash"), "terms": pa.array(terms, pa.list_(pa.string())),
        })


def _counts(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and of each term of ``place`` in the text its number and count."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", SLICE):
            w = coded(part.column("text"), _TERM)
            number = np.array([place.get(x, -1) for x in w.words.to_pylist()], dtype=np.int64)
            of = number[w.code] if len(w.code) else np.zeros(0, dtype=np.int64)
            known = of >= 0
            key, tf = np.unique(w.row[known] * len(place) + of[known], return_counts=True)
            first = np.searchsorted(key, np.arange(part.num_rows + 1) * len(place)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n": np.bincount(w.row, minlength=part.num_rows).astype(np.int64),
                "terms": pa.ListArray.from_arrays(first, pa.array((key % max(len(place), 1)).astype(np.int32))),
                "tfs": pa.ListArray.from_arrays(first, pa.array(tf.astype(np.int64))),
            })


class _Best:
    """The k best (score, id) of one item; of equal scores the lesser id. Ids come with a null first."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) >= self.k:
            held = score >= self.score[-1]
            score, ids = score[held], ids[held]
        if len(score) > 4 * self.k:  # those at the k-th score stay, all of them: their ids decide
            held = score >= np.partition(score, -self.k)[-self.k]
            score, ids = score[held], ids[held]
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[best], ids[best]


_NULL = -(2**63)


def _ranked(
    batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weight: np.ndarray, corpus: int, length: int, k: int, shape: tuple[int, int, int]
) -> Iterator[pa.RecordBatch]:
    """item, doc_id and score of the k best documents of this task for each item; ``shape`` is TILE_ITEMS, TILE_CELLS and EXACT."""
    tile_items, tile_cells, exact = shape
    best = [_Best(k) for _ in items]
    tiles = []
    for lo in range(0, len(items), tile_items):
        held = items[lo : lo + tile_items]
        terms = np.unique(np.concatenate(held))
        table = np.zeros((len(terms), len(held)))
        for j, own in enumerate(held):
            table[np.searchsorted(terms, own), j] = weight[own]
        column = np.full(len(weight), -1, dtype=np.int32)
        column[terms] = np.arange(len(terms))
        tiles.append((lo, column, table))
    # no impact reaches 10**6
    strip = max(1, int(exact // (10**6 * max(1, int(weight.max(initial=0)))) - 1))
    for batch in batches:
        ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(_NULL))
        n = np.asarray(batch.column("n"))
        listed = batch.column("terms")
        count = np.asarray(listed.value_lengths(), dtype=np.int64)
        term, tf = np.asarray(listed.flatten()), np.asarray(batch.column("tfs").flatten())
        row = np.repeat(np.arange(len(n)), count)
        m = np.array([10 + 90 * x * corpus // length for x in n.tolist()], dtype=np.int64) if length else np.zeros(len(n), dtype=np.int64)
        impact = 10**9 * tf // (1000 * tf + 8 * m[row])
        for lo, column, table in tiles:
            at = column[term]
            own = np.flatnonzero(at >= 0)
            if not len(own):
                continue
            rows, local = np.unique(row[own], return_inverse=True)
            height = max(1, tile_cells // table.shape[0])
            for top in range(0, len(rows), height):
                a, b = np.searchsorted(local, [top, top + height])  # rows come in order
                size = min(height, len(rows) - top)
                score = np.zeros((size, table.shape[1]), dtype=np.int64)
                dense = np.zeros((size, table.shape[0]))
                dense[local[a:b] - top, at[own[a:b]]] = impact[own[a:b]]
                for s in range(0, table.shape[0], strip):
                    score += (dense[:, s : s + strip] @ table[s : s + strip]).astype(np.int64)
                of = ids[rows[top : top + size]]
                for j in range(table.shape[1]):
                    found = score[:, j] > 0
                    best[lo + j].take(score[found, j], of[found])
    number = np.repeat(np.arange(len(items), dtype=np.int32), [len(x.id) for x in best])
    ids = np.concatenate([x.id for x in best]) if best else np.zeros(0, dtype=np.int64)
    score = np.concatenate([x.score for x in best]) if best else np.zeros(0, dtype=np.int64)
    yield pa.RecordBatch.from_pydict({"item": number, "doc_id": pa.array(ids, mask=ids == _NULL), "score": score})


def _block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """Ranking of one block of items: rows (item_id, item_hash, terms)."""
    spark = docs.sparkSession
    terms = sorted({t for _, _, held in items for t in held})
    number = {t: i for i, t in enumerate(terms)}
    place = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})
    counts = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _counts(batches, place.value), "doc_id long, n long, terms array<int>, tfs array<long>"
    ), "term-counts")
    corpus, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for term, held in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[term] = held
    weight = np.array([math.floor(1000 * math.log((2 * corpus + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], dtype=np.int64)
    held = spark.sparkContext.broadcast(([np.array([number[t] for t in own], dtype=np.int64) for _, _, own in items], weight))
    found = counts.where(F.size("terms") > 0).mapInArrow(
        lambda batches: _ranked(batches, *held.value, corpus, length, k, (TILE_ITEMS, TILE_CELLS, EXACT)), "item int, doc_id long, score long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, a, h) for i, (a, h, _) in enumerate(items)], "item int, item_id long, item_hash long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "item_hash", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, item_hash, rank, doc_id and score of the ``k`` best documents (doc_id, text) for every item (item_id, text)."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").dropDuplicates()
    named = settle(named.select("item_id", F.xxhash64("text").alias("item_hash"), "text").mapInArrow(
        _items, "item_id long, item_hash long, terms array<string>"
    ).where(F.size("terms") > 0), "search-items")
    blocks = math.ceil((named.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(max(blocks, 1)))
    found = None
    for b in range(blocks):
        own = named.where(block == b).orderBy("item_id", "item_hash").collect()  # BLOCK_TERMS terms on average, by design
        if own:
            ranked = _block(docs, [tuple(x) for x in own], k)
            found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, item_hash long, rank int, doc_id long, score long")
    return found


_SQL_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH t AS (SELECT doc_id, unnest({_SQL_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(DISTINCT doc_id)::BIGINT AS nn, count(*)::BIGINT AS ll FROM t),
l AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, nn),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = only(load(spark, sf_dir, "documents"), "doc_id", "text"), only(load(spark, sf_dir, "benchmark"), "item_id", "text")
    return rank_documents(docs, items, k=10).select("item_id", "rank", "doc_id", "score")
