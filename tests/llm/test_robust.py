"""Names that clash or are no identifiers, words made to collide, texts over a slice, hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.llm import (
    bitfilter, common, decontamination, lexical_search, line_dedup, near_dedup, piece_lattice, quality, sharding, substring_dedup, token_counts,
    wordhash,
)
from helpers import brute_classes, brute_substrings, prose


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names are no identifiers, or those that operators use inside."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), "x", "y", *"abcdefg") for i in range(20)]
    names = ["my col", "a.b", "rank", "_row", "_part", "_cell0", "_at", "_before", "source-url"]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


def test_operators_carry_odd_names(odd, spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    whole = {tuple(r) for r in odd.collect()}
    for got in (
        substring_dedup.dedup_substrings(odd).drop("n_words", "n_removed"), near_dedup.drop_near_duplicates(odd),
        line_dedup.dedup_lines(odd).drop("n_lines", "n_dropped"), decontamination.decontaminate(odd, bench),
        sharding.hilbert_shards(odd, ["a.b", "my col"], 3, ["doc_id"]).drop("hilbert", "shard", "slot"),
    ):
        assert got.columns == odd.columns
        assert {tuple(r) for r in got.collect()} == whole
    assert quality.filter_quality(odd).columns == odd.columns
    encoded = piece_lattice.encode(odd)
    assert {tuple(r) for r in encoded.select("_row.*").collect()} == {r[2:] for r in whole}
    assert {r.decoded for r in piece_lattice.decode(encoded).collect()} == {r[1] for r in whole}
    assert token_counts.count_tokens(odd).count() == 20
    assert lexical_search.rank_documents(odd, bench.withColumn("a.b", F.lit(1))).columns == ["item_id", "item_hash", "rank", "doc_id", "score"]


def test_words_that_collide_under_polynomials_stay_apart(spark):
    """Thue-Morse strings have equal polynomial hashes modulo 2**64, whatever the odd base."""
    bits = thue_morse(2048)
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    shared = prose(random.Random(1), 19)
    rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_substrings(docs, 20).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(20, 0), (20, 0)]
    # whole texts of two words in Thue-Morse order
    words = [(1, " ".join("ab"[x] for x in bits)), (2, " ".join("ba"[x] for x in bits)), (3, a), (4, b)]
    docs = spark.createDataFrame(words, "doc_id long, text string")
    got = {r._id: (r.class_id, r.node) for r in near_dedup.near_classes(docs).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for (i, _), c in zip(words, brute_classes(words), strict=True)}
    assert len({n for _, n in got.values()}) == 4


def test_texts_over_a_slice(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(330_000))  # 2.4 MB
    part = " ".join(long.split(" ")[200_000:200_100])
    rows = [(1, long), (2, "before " + part + " after"), (3, long), (4, part)]
    assert len(long) > 2 * wordhash.SLICE_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(docs, 20).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute_substrings(rows, 20), strict=True)}
    classes = {r._id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 1, 4: 2}


def test_hot_keys_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_HOT", 3)
    many = spark.range(1000).select(F.when(F.col("id") < 800, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    times = many.groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    got = common.join_spread(many, one, ["k"], times, ["v"])
    assert sorted(got.columns) == ["k", "name", "v"]
    assert {(r.k, r.v, r.name) for r in got.collect()} == {(7 if v < 800 else v, v, f"n{7 if v < 800 else v}") for v in range(1000)}


def test_bitmaps_miss_nothing(spark):
    values = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    bits = bitfilter.bitmap(spark.createDataFrame([(int(v),) for v in values], "h long"))
    assert bitfilter.passes(bits, values.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(1, 2**63, 5000, dtype=np.uint64)
    assert bitfilter.passes(bits, other).mean() < 0.2


def test_settled_tables_are_released(spark):
    df = common.settle(spark.range(5), "five")
    path = df.inputFiles()[0]
    assert df.count() == 5
    common.release(df)
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_contamination_by_shuffle_equals_that_by_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    items = [(j, prose(rng, n)) for j, n in enumerate([5, 9, 30, 60])]
    texts = [(j, prose(rng, 300) + " " + t + " " + prose(rng, 50)) for j, t in items] + [(9, None), (10, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r._id, r.item_id, r.n_shared) for r in decontamination.contamination(docs, bench).collect())
    near = found()
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    assert found() == near and len(near) == 4


def test_long_texts_of_open_buckets_are_verified_apart(spark):
    """Blocks carry no text over LONG_TEXT shingles; such pairs come back unsure and are verified on the texts."""
    rng = random.Random(3)
    n = near_dedup.LONG_TEXT + 500
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    table = {"bucket": [9, 9], "i": [0, 0], "j": [0, 0], "side": [2, 2], "node": [1, 2], "component": [1, 2], "size": [float(n - 4)] * 2,
             "bytes": [bytes(240)] * 2, "bands": [[9], [9]], "text": [None, None]}
    import pyarrow as pa

    found = near_dedup._links_of_blocks(pa.table({k: pa.array(v, pa.string()) if k == "text" else v for k, v in table.items()}), 0.8)
    assert found.to_pylist() == [{"a": 1, "b": 2, "sure": False}]
    texts = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[: n - 50], *map(str, range(50))])), (3, " ".join(base[: n // 2]))], "node long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in near_dedup.verified(pairs, texts, 0.8).collect()] == [(1, 2)]
