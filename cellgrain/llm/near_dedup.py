"""MinHash near-dedup with DartMinHash signatures of weighted shingles.

A text is the multiset of its five-word shingles; a shingle's weight is how often it occurs. Every shingle has a
fixed cloud of darts in the plane weight x time, drawn from its hash cell by cell (a Poisson number per unit cell). A
text throws the darts that fall under its shingles' weights and before a time that its total weight sets, so
that about k ln k + 2k darts fall whatever its length; each dart hits one of k coordinates, and the earliest on
a coordinate stays. Two texts agree on a coordinate with the probability of their weighted Jaccard similarity.
(After Christiani, "DartMinHash: Fast sketching for weighted sets", 2020.)

Signatures are cut into bands. Texts that share a band meet in a bucket, and links are verified exactly on the
texts. Buckets are not expanded into all pairs: equal texts are one node, each member meets one leader of its
bucket, and only buckets whose members are still in different components meet again, first with other leaders,
then pair by pair across components, in blocks of bounded size inside tasks. There, pairs whose whole signatures
agree far too little for the threshold (five and a half standard deviations) or whose weights differ too much are not
verified, the others at once; only links leave the task. With 40 bands of 6 rows a pair at similarity 0.8 shares no band
with a chance of 5.2e-6 and falls below that bound with one of 1e-7, so it is missed with a chance of 5.4e-6 at most.

Defined results: words are split at 0x20 and 0x09-0x0D and lower-cased. A text of one to four words is one shingle.
A null text, or one without words, is a class of its own row. Rows with the same words are copies and share a
class. The class id is the least doc_id of the class (null only if all are). Other columns pass; empty in, empty
out. Texts of any length are taken whole. Texts are told apart by 128 bits over the 128-bit hashes of their words; shingles are
compared by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm import wordhash
from cellgrain.llm.common import join_spread, load, on_row_key, only, packed, query, release, row_key, settle, unpacked
from cellgrain.llm.components import connected
from cellgrain.llm.wordhash import U, mix

SHINGLE = 5
BANDS, ROWS = 40, 6
#: The round after the first in which the rest meets pair by pair, members of a block there, and the most shingles
#: of a text that travels with its block.
LEADER_ROUNDS, BLOCK, LONG_TEXT = 2, 1024, 5000
#: How many standard deviations fewer places than expected may agree before a pair is left unverified.
DEVIATIONS = 5.5
_GOLDEN = U(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


# ---- signatures -----------------------------------------------------------------------------------------------
def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, wordhash.Words]:
    """(row, shingle hash, weight) in order of row and hash, and the words they are made of."""
    w = wordhash.words(pc.utf8_lower(column))
    n_words = np.diff(w.first)
    at = wordhash.starts_inside(w, SHINGLE)
    hashed, row = wordhash.windows(w.hashes[0], SHINGLE)[at], w.row[at]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        row = np.concatenate([row, short])
        hashed = np.concatenate([hashed, wordhash.sequences(w, w.first[short], w.first[short + 1])[:, 0]])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    first = np.flatnonzero(new)
    return row[first], hashed[first], np.diff(np.append(first, len(row))).astype(np.float64), w


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k array with the earliest dart of each coordinate, 0 where none fell. Any positive weights do."""
    total = np.bincount(row, weights=weight, minlength=rows)
    until = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    wide, long = np.ceil(weight).astype(np.int64), np.ceil(until[row]).astype(np.int64)
    out, best = np.zeros(rows * k, dtype=np.uint64), np.full(rows * k, np.inf)
    cells, at = wide * long, 0
    ends = np.cumsum(cells)
    while at < len(row):  # a bounded number of cells at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        n = cells[at:to]
        e = np.repeat(np.arange(at, to), n)
        inner = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        m, c = inner // long[e], inner % long[e]
        cell = mix(element[e] ^ mix((m * 0x10001 + (c << 20) + 1).astype(np.uint64) * _GOLDEN))
        darts = np.searchsorted(_POISSON, (cell >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        which = np.repeat(np.arange(len(e)), darts)
        d = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[which] + (d + 1).astype(np.uint64) * _GOLDEN)
        place = mix(dart ^ U(0x94D049BB133111EB))
        e, time = e[which], c[which] + (place >> U(32)).astype(np.float64) * 2.0**-32
        held = time < until[row[e]]
        if (weight[at:to] % 1).any():
            height = m[which] + (mix(dart ^ U(0xBF58476D1CE4E5B9)) >> U(11)).astype(np.float64) * 2.0**-53
            held &= height < weight[e]
        dart, time, key = dart[held], time[held], row[e[held]] * k + ((place[held] & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)
        np.minimum.at(best, key, time)
        won = best[key] == time
        out[key[won]] = np.maximum(dart[won], U(1))
        at = to
    return out.reshape(rows, k)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    k = bands * rows
    for batch in batches:
        for part in wordhash.slices(batch, "text", 1 << 20):
            row, element, weight, w = elements(part.column("text"))
            whole, wordless = wordhash.sequences(w, w.first[:-1], w.first[1:]), w.first[1:] == w.first[:-1]
            signature = dart_signatures(row, element, weight, part.num_rows, k)
            grouped = signature.reshape(part.num_rows, bands, rows)
            band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, grouped.shape[:2]).copy()
            for i in range(rows):
                band = mix(band ^ grouped[:, :, i]) * _GOLDEN
            missing = (grouped == 0).any(axis=2).ravel()
            size = np.bincount(row, weights=weight, minlength=part.num_rows)
            yield pa.RecordBatch.from_pydict({
                "_id": part.column("_id"), "_text_hash": part.column("_text_hash"),
                "a": pa.array(wordhash.signed(whole[:, 0].copy()), mask=wordless), "b": pa.array(wordhash.signed(whole[:, 1].copy()), mask=wordless),
                "size": pa.array(size),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(missing) + 1, bands, dtype=np.int32)),
                    pa.array(wordhash.signed(band.ravel()), mask=missing),
                ),
                "bytes": pa.array([s.tobytes() for s in (signature & U(0xFF)).astype(np.uint8)], pa.binary()),
            })


# ---- verification ---------------------------------------------------------------------------------------------
def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts."""
    rows, hashes, weights = [], [], []
    for column in (left, right):
        row, element, weight, _ = elements(column)
        rows.append(row), hashes.append(element), weights.append(weight)
    totals = [np.bincount(r, weights=w, minlength=len(left)) for r, w in zip(rows, weights, strict=True)]
    row, hashed, weight = np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)
    order = np.lexsort((hashed, row))
    row, hashed, weight = row[order], hashed[order], weight[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1]))
    shared = np.bincount(row[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=len(left))
    return shared / np.maximum(totals[0] + totals[1] - shared, 1e-300)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wordhash.slices(batch, "a_text", 1 << 20):
            held = pa.array(similarities(part.column("a_text"), part.column("b_text")) >= threshold)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(held), part.column("b").filter(held)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose texts are similar. A leader of many pairs has its text copied to several tasks."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    pairs = settle(pairs.distinct(), "pairs")
    met = join_spread(pairs.join(b, "b"), a, ["a"], pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")), ["b"])
    return met.select("a", "b", "a_text", "b_text").mapInArrow(lambda batches: _verify(batches, threshold), "a long, b long")


def least_agreement(threshold: float, k: int) -> float:
    """Places of k in which two signatures agree at the least, if the texts are as similar as the threshold."""
    return threshold * k - DEVIATIONS * math.sqrt(threshold * (1 - threshold) * k)


def _links_of_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Links across components of one pair of blocks: (a, b, sure).

    Signatures and sizes leave few pairs; those are verified here on the texts, each in the bucket of the first band
    that it shares. Pairs with a text over LONG_TEXT shingles come without their text and are left open.
    """
    table = table.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
    side = np.asarray(table["side"])
    node, component, size = (np.asarray(table[c]) for c in ("node", "component", "size"))
    signature = np.stack([np.frombuffer(x, dtype=np.uint8) for x in table["bytes"].to_pylist()])
    bucket = table["bucket"][0].as_py()
    bands = np.array([[x or 0 for x in held] for held in table["bands"].to_pylist()], dtype=np.int64)
    row, element, weight, _ = elements(pa.concat_arrays(table["text"].chunks))
    first = np.searchsorted(row, np.arange(len(node) + 1))
    k = signature.shape[1]
    least = least_agreement(threshold, k)
    left = np.flatnonzero(side != 1)  # side 2: one block with itself
    right = np.flatnonzero(side != 0)
    a, b, sure = [], [], []
    for i in left:
        held = right[(component[right] != component[i]) & (np.minimum(size[right], size[i]) >= threshold * np.maximum(size[right], size[i]) - 1e-9)]
        if side[i] == 2:
            held = held[node[held] > node[i]]
        held = held[(signature[held] == signature[i]).sum(axis=1) >= least]
        both = (bands[held] == bands[i]) & (bands[i] != 0)
        for j in held[bands[i][both.argmax(axis=1)] == bucket] if len(held) else held:
            known = max(size[i], size[j]) <= LONG_TEXT
            if known:
                x, y = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])
                _, at, to = np.intersect1d(element[x], element[y], assume_unique=True, return_indices=True)
                shared = np.minimum(weight[x][at], weight[y][to]).sum()
                if shared < threshold * (size[i] + size[j] - shared):
                    continue
            a.append(min(node[i], node[j])), b.append(max(node[i], node[j])), sure.append(known)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})


def _rest(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, sure) left in the open buckets (bucket, n, node, component), block against block.

    One task holds two blocks at most, and only what is found leaves it, so a bucket of many unlike texts makes
    no rows for its pairs.
    """
    placed = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    known = nodes.select("node", "size", "bytes", "bands").join(texts, "node").withColumn("text", F.when(F.col("size") <= LONG_TEXT, F.col("text")))
    placed = placed.join(known, "node")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    carried = ("node", "component", "size", "bytes", "bands", "text")
    dealt = placed.select("bucket", "block", *carried, meets).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *carried,
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return dealt.groupBy("bucket", "i", "j").applyInArrow(lambda t: _links_of_blocks(t, threshold), "a long, b long, sure boolean")


# ---- classes --------------------------------------------------------------------------------------------------
def _with_component(members: DataFrame, components: DataFrame) -> DataFrame:
    named = components.select("node", F.col("component").alias("_named"))
    return members.join(named, "node", "left").withColumn("component", F.coalesce("_named", "node")).drop("_named")


def nodes_of(signed: DataFrame) -> DataFrame:
    """One numbered node for each distinct text with words: texts are told apart by 128 bits (a, b) of their words.

    The number is given when the table is written, so it stays the same; ``row`` is the row whose text stands for all.
    """
    found = signed.where("a IS NOT NULL").groupBy("a", "b").agg(
        F.min(F.struct("_id", "_text_hash")).alias("row"), F.min("_id").alias("least_id"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("times"),
    )
    return settle(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect the nodes of every class: verified ones, or stars in place of those found before."""
    members = nodes.select("node", F.explode("bands").alias("bucket")).where("bucket IS NOT NULL")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = settle(members.join(shared, "bucket"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "row._id", "row._text_hash")
    texts = on_row_key(docs.select(*row_key(), "text"), wanted, "inner")
    texts = settle(texts.groupBy("node").agg(F.first("text").alias("text")), "node-texts")
    links = settle(verified(
        members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), texts, threshold
    ), "links")
    buckets = members
    members = members.select("bucket", "node")
    for turn in range(1, LEADER_ROUNDS + 1):
        components = connected(links)
        members = _with_component(members, components)
        counts = members.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("leader"),
        ).where("lo <> hi")
        members = settle(members.join(counts.select("bucket", "n", "leader"), "bucket"), "open-buckets")
        release(buckets, links)
        buckets = members
        stars = components.select(F.col("component").alias("a"), F.col("node").alias("b"))
        if members.isEmpty():
            release(texts, members)
            return stars
        if turn == LEADER_ROUNDS:
            found = settle(_rest(members.select("bucket", "n", "node", "component"), nodes, texts, threshold), "rest")
            links = stars.union(found.where("sure").select("a", "b").distinct())
            links = settle(links.union(verified(found.where("NOT sure").select("a", "b"), texts, threshold)), "links")
            release(texts, members, found)
        else:
            pairs = members.where(F.col("component") != F.col("leader.component")).select(
                F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")
            )
            links = settle(stars.union(verified(pairs, texts, threshold)), "links")
        members = members.select("bucket", "node")
    return links


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """_id, _text_hash, class_id and node of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select(*row_key(), "text")
    signed = settle(keyed.mapInArrow(
        lambda batches: _sign(batches, BANDS, ROWS),
        "_id long, _text_hash long, a long, b long, size double, bands array<long>, bytes binary",
    ), "signatures")
    nodes = nodes_of(signed)
    components = connected(near_links(docs, nodes, threshold))
    # classes are named over distinct texts; rows meet the name of their text, a text of many rows in several tasks
    placed = settle(_with_component(nodes.select("node", "a", "b", "least_id", "times"), components), "placed")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("times"), F.min("least_id").alias("class_id"))
    sizes = settle(sizes, "classes")
    named = join_spread(placed, sizes.select("component", "class_id"), ["component"], sizes.drop("class_id"), ["node"])
    named = settle(named.select("a", "b", "node", "class_id", "times"), "names")
    rows = signed.select("_id", "_text_hash", "a", "b")
    met = join_spread(rows.where("a IS NOT NULL"), named.drop("times"), ["a", "b"], named.select("a", "b", "times"), ["_id", "_text_hash"])
    wordless = rows.where("a IS NULL").select("_id", "_text_hash", F.col("_id").alias("class_id"), F.lit(None).cast("long").alias("node"))
    return met.select("_id", "_text_hash", "class_id", "node").unionByName(wordless)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class: the one with the least doc_id. Rows without words all stay."""
    classes = near_classes(docs, threshold)
    keys = F.struct("_id", "_text_hash")
    kept = classes.where("node IS NOT NULL").groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("_own")).agg(F.min(keys).alias("k"))
    kept = settle(kept.select("k._id", "k._text_hash").distinct(), "kept-of-classes")
    key_id, key_hash = row_key()
    keyed = packed(docs).withColumns({"_id": key_id, "_text_hash": key_hash})
    wordless = F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""
    first = on_row_key(keyed.where(~wordless), kept, "inner").dropDuplicates(["_id", "_text_hash"])
    return unpacked(first, docs).unionByName(unpacked(keyed.where(wordless), docs))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    return near_classes(docs).select(F.col("_id").alias("doc_id"), "class_id")
