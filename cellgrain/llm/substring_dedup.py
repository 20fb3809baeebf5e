"""Substring dedup by level-wise doubling: word windows that repeat elsewhere lose their later occurrences.

A word goes if it lies in a window of ``length`` words whose word sequence also starts earlier: in a row with a
smaller doc_id, or earlier in the same text. Levels are length/4, length/2 and length. Only what repeats at one
level alone is extended to the next, until the target length or until nothing survives.

* First level: one short window stands for many long ones. Each long window is represented by its least short
  window (its anchor, the leftmost on ties); equal long windows have equal anchors, so nothing is lost, and about
  2/17 as many rows as words are counted at length 20. Neighbouring long windows with one anchor form a run, at
  most ``3 * length / 4 + 1`` of them. If every occurrence of a repeated anchor has the same run around it, the run
  repeats as a whole and is settled there. Other repeated anchors go on.
* Second level: the anchor doubled to the left or to the right, whichever side the long window reaches.
* Third level: the long windows themselves, by 128-bit hashes.

Texts stay where they are until they are cut: each level is a scan of its own, which learns from a bitmap (``bitfilter``)
what the level before has left. Bitmaps lose nothing; what they let through beyond that falls to the exact counts of
the level. So a level moves hashes of what may still repeat, and texts move once, to meet their cuts.

What is first is found by an aggregate of partial minima per hash, then joined back. No list of occurrences is
gathered, so a passage in a third of all rows is merged before the shuffle, and the join deals the rows of a hot passage
over several tasks. Tables written on the way are deleted as soon as their successor is written.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D; kept words are joined by one blank. A null
text has no words and stays null; a text shorter than ``length`` keeps all words. A null doc_id is smaller
than any other. Rows that share a doc_id do not make each other's windows repeats, only earlier ids and the row's
own earlier words do. n_words and n_removed replace columns of those names; others pass, whatever their names. Texts of
any length are taken whole; one longer than a slice is a slice by itself. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.llm import wordhash
from cellgrain.llm.bitfilter import bitmap, passes
from cellgrain.llm.common import join_spread, load, on_row_key, only, packed, packed_schema, query, release, row_key, settle, unpacked
from cellgrain.llm.wordhash import U, Words

_LEAST = -(2**63)
#: Bytes of text that are looked at together.
SLICE = 4 << 20
_RUN = np.random.default_rng(20240301).integers(1, 2**63, wordhash.MAX_WINDOW, dtype=np.uint64) * U(2) + U(1)


def _seen_before(*keys: np.ndarray) -> np.ndarray:
    """Whether an equal combination of keys stands earlier in the arrays."""
    order = np.lexsort(keys)  # stable: earlier entries first
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    out = np.zeros(len(order), dtype=bool)
    out[order[1:]] = same
    return out


def _anchored(part: pa.RecordBatch, length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, its long windows, the anchor of each, and the hash of each anchor."""
    short = length // 4
    w = wordhash.words(part.column("text"))
    at = wordhash.starts_inside(w, length)
    anchors = wordhash.windows(w.hashes[0], short)
    anchor = wordhash.least_of(anchors, length - short + 1)[at] if len(at) else at
    return w, at, anchor, anchors[anchor]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a combination of keys differs from the one before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(hashes: np.ndarray) -> pa.RecordBatch:
    found, n = np.unique(hashes, return_counts=True)
    return pa.RecordBatch.from_pydict({"h": wordhash.signed(found), "n": n.astype(np.int64)})


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the anchors, with the runs of each."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", SLICE):
            w, at, anchor, hashed = _anchored(part, length)
            if len(at):
                yield _counted(hashed[_starts(anchor, w.row[at])])


def _runs(batches: Iterator[pa.RecordBatch], length: int, repeated: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of anchors that may repeat: anchor hash, run hash, first window, number of windows, seen before in the text."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", SLICE):
            w, at, anchor, hashed = _anchored(part, length)
            if not len(at):
                continue
            first = _starts(anchor, w.row[at])
            n = np.diff(np.append(first, len(at)))
            held = passes(repeated, hashed[first])
            first, n = first[held], n[held]
            start, m, row = at[first], anchor[first], w.row[at[first]]
            words = n + length - 1
            content = np.zeros(len(start), dtype=np.uint64)
            for k in range(int(words.max(initial=0))):
                inside = k < words
                content[inside] += _RUN[k] * w.hashes[1][start[inside] + k]
            run = wordhash.mix(content ^ wordhash.mix((n * 4 * length + (m - start)).astype(np.uint64)))
            anchor_hash = hashed[first]
            yield pa.RecordBatch.from_pydict({
                "anchor": wordhash.signed(anchor_hash), "run": wordhash.signed(run),
                "_id": part.column("_id").take(pa.array(row)), "_text_hash": part.column("_text_hash").take(pa.array(row)),
                "at": (start - w.first[row]).astype(np.int32), "n": n.astype(np.int32), "again": _seen_before(anchor_hash, row),
            })


def _reaching(part: pa.RecordBatch, length: int, still_open: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, then of the long windows over open anchors: the window, its anchor, its side, and the hash of the anchor doubled to it."""
    short = length // 4
    w, at, anchor, hashed = _anchored(part, length)
    held = passes(still_open, hashed) if len(at) else np.zeros(0, dtype=bool)
    p, m = at[held], anchor[held]
    left = m - p >= short
    half = wordhash.windows(w.hashes[0], 2 * short)
    return w, p, m, left, wordhash.mix(half[np.where(left, m - short, m)] ^ left.astype(np.uint64))


def _doubled(batches: Iterator[pa.RecordBatch], length: int, still_open: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes of doubled open anchors, with their occurrences."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", SLICE):
            w, p, m, left, doubled = _reaching(part, length, still_open)
            if len(p):
                yield _counted(doubled[_starts(m, left, w.row[p])])


def _windows(batches: Iterator[pa.RecordBatch], length: int, still_open: np.ndarray, survivors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Long windows over open anchors whose doubled form may repeat: hash, place, seen before in the text."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", SLICE):
            w, p, _, _, doubled = _reaching(part, length, still_open)
            p = p[passes(survivors, doubled)]
            if not len(p):
                continue
            a, b = (wordhash.windows(h, length, lane)[p] for lane, h in enumerate(w.hashes))
            row = w.row[p]
            yield pa.RecordBatch.from_pydict({
                "a": wordhash.signed(a), "b": wordhash.signed(b),
                "_id": part.column("_id").take(pa.array(row)), "_text_hash": part.column("_text_hash").take(pa.array(row)),
                "at": (p - w.first[row]).astype(np.int32), "again": _seen_before(b, a, row),
            })


def _id_order() -> Column:
    return F.coalesce(F.col("_id"), F.lit(_LEAST))


def _repeated(counted: DataFrame, name: str) -> np.ndarray:
    """Bitmap of the hashes that occur more than once."""
    found = settle(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), name)
    bits = bitmap(found)
    release(found)
    return bits


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """Per row key the word ranges to remove, as an array ``cut`` of (at, words); a settled table."""
    if length % 4 or not 8 <= length <= wordhash.MAX_WINDOW // 2:
        raise ValueError("length must be a multiple of 4, from 8 to 2048")
    share = docs.sparkSession.sparkContext.broadcast
    keyed = docs.select(*row_key(), "text").where("text IS NOT NULL")
    texts = keyed.select("text")
    repeated = share(_repeated(texts.mapInArrow(lambda x: _anchors(x, length), "h long, n long"), "anchors"))
    runs = settle(keyed.mapInArrow(
        lambda x: _runs(x, length, repeated.value), "anchor long, run long, _id long, _text_hash long, at int, n int, again boolean"
    ), "runs")
    level = settle(runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"), F.min(_id_order()).alias("first_id"), F.min("run").alias("lo"), F.max("run").alias("hi")
    ).where("times > 1").select("anchor", "times", "first_id", (F.col("lo") != F.col("hi")).alias("open")), "anchor-counts")
    known = level.where("NOT open")
    found = join_spread(runs, known.select("anchor", "first_id"), ["anchor"], known.select("anchor", "times"), ["_id", "_text_hash"])
    found = found.where(F.col("again") | (_id_order() > F.col("first_id")))
    whole = settle(found.select("_id", "_text_hash", "at", (F.col("n") + length - 1).alias("words")), "repeated-runs")
    still_open = share(bitmap(level.where("open").select("anchor")))
    release(runs, level)

    survivors = share(_repeated(texts.mapInArrow(lambda x: _doubled(x, length, still_open.value), "h long, n long"), "doubled"))
    windows = settle(keyed.mapInArrow(
        lambda x: _windows(x, length, still_open.value, survivors.value), "a long, b long, _id long, _text_hash long, at int, again boolean"
    ), "windows")
    last = settle(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(_id_order()).alias("first_id")).where("times > 1"), "window-counts")
    late = join_spread(windows, last.drop("times"), ["a", "b"], last.drop("first_id"), ["_id", "_text_hash"])
    late = late.where(F.col("again") | (_id_order() > F.col("first_id"))).select("_id", "_text_hash", "at", F.lit(length).alias("words"))
    # sets: rows that share id and text bring the same entries, however often they repeat
    ranges = settle(whole.unionByName(late).groupBy("_id", "_text_hash").agg(F.collect_set(F.struct("at", "words")).alias("cut")), "ranges")
    release(whole, windows, last)
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of their kept words, with n_words and n_removed; ``cut`` goes."""
    for batch in batches:
        texts, n_words, n_removed = [], [], []
        for text, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # just these six blanks
            n_words.append(len(words))
            removed = 0
            if cut.is_valid and len(cut):
                edges = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(edges, np.asarray(cut.values.field("at")), 1)
                np.add.at(edges, np.asarray(cut.values.field("at")) + np.asarray(cut.values.field("words")), -1)
                keep = np.cumsum(edges[:-1]) == 0
                removed = len(words) - int(keep.sum())
                words = compress(words, keep.tolist())
            n_removed.append(removed)
            texts.append(b" ".join(words).decode() if text.is_valid else None)
        columns = {
            "doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "_row": batch.column("_row"),
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(columns)


def dedup_substrings(docs: DataFrame, length: int = 20) -> DataFrame:
    """``docs`` with text cut to its kept words, and n_words and n_removed added."""
    ranges = repeated_ranges(docs, length)
    held = packed(docs)
    key_id, key_hash = row_key()
    joined = on_row_key(held.withColumns({"_id": key_id, "_text_hash": key_hash}), ranges, "left")
    out = joined.select("doc_id", "text", "_row", "cut").mapInArrow(
        _cut, packed_schema(held, ("n_words", T.LongType()), ("n_removed", T.LongType()))
    )
    return unpacked(out, docs, "n_words", "n_removed")


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_substrings(docs, length=20).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
