"""Operators on documents: awkward rows, empty tables, brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgrain.llm import decontamination, line_dedup, near_dedup, quality, sharding, substring_dedup, token_counts
from helpers import SCHEMA, awkward_rows, brute_classes, brute_repeat_words, brute_substrings, prose, words

ROWS = awkward_rows()
PAIRS = [r[:2] for r in ROWS]


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings_equal_brute_force(docs):
    got = substring_dedup.dedup_substrings(docs.drop("n_words"), 20).collect()
    want = [(i, *x) if t is not None else (i, *x[:2], None) for (i, t), x in zip(PAIRS, brute_substrings(PAIRS, 20), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r["_id"] == "kept" and r.lang == "en" for r in got)


@pytest.mark.parametrize("length", [8, 12, 20])
def test_substrings_with_edges_and_few_words(spark, length):
    """Texts from a tiny vocabulary and overlapping passages: many windows repeat, at many offsets."""
    import random

    rng = random.Random(length)
    passages = [prose(rng, 30).split(" ") for _ in range(4)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            text += p[a : a + rng.randint(5, 30)] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(text)))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    want = brute_substrings(rows, length)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_near_classes_equal_brute_force(docs):
    got = near_dedup.near_classes(docs.select("doc_id", "text")).collect()
    want = [(i, c) for (i, _), c in zip(PAIRS, brute_classes(PAIRS), strict=True)]
    assert sorted(((r._id, r.class_id) for r in got), key=key) == sorted(want, key=key)


def test_near_duplicates_keep_one_of_each_class(docs):
    kept = near_dedup.drop_near_duplicates(docs).collect()
    classes = {c for (_, t), c in zip(PAIRS, brute_classes(PAIRS), strict=True) if words(t)}
    assert sum(bool(words(r.text)) for r in kept) == len(classes)
    assert sum(not words(r.text) for r in kept) == sum(not words(t) for _, t in PAIRS)
    assert kept[0].asDict().keys() == dict.fromkeys(c for c in docs.columns).keys()


def test_many_near_copies_meet_through_leaders_and_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)
    base = prose(rng, 200).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"w{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {r._id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute_classes(rows), strict=True)}


def test_block_round_verifies_pairs_whose_signatures_agree_little():
    k = near_dedup.BANDS * near_dedup.ROWS
    bound = math.ceil(near_dedup.least_agreement(0.8, k))
    below = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(bound))
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS + below < 5.4e-6
    rng = random.Random(3)
    base = prose(rng, 200).split(" ")
    texts = [" ".join(base), " ".join([*base[:100], "changed", *base[101:]])]
    size = float(len(base) - 4)
    signature = [bytes(k), bytes(160) + b"\1" * (k - 160)]
    table = pa.table({
        "bucket": [9, 9], "i": [0, 0], "j": [0, 0], "side": pa.array([2, 2], pa.int32()), "node": [1, 2], "component": [1, 2], "size": [size, size],
        "bytes": signature, "bands": [[9], [9]], "text": texts,
    })
    assert near_dedup._links_of_blocks(table, 0.8).to_pylist() == [{"a": 1, "b": 2, "sure": True}]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    row = np.repeat([0, 1], 300)
    k = 2048
    s = near_dedup.dart_signatures(row, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (s != 0).mean() > 0.999
    assert abs((s[0] == s[1]).mean() - want) < 5 * (want * (1 - want) / k) ** 0.5


def test_lines(docs):
    got = line_dedup.dedup_lines(docs, 10, 1).collect()
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = [(t or "").split("\n") for _, t in PAIRS]
    keys = [[x.strip(strip).translate(lower) for x in held] for held in lines]
    times = {}
    for held in keys:
        for k in set(held):
            times[k] = times.get(k, 0) + 1
    want = []
    for (i, t), held, ks in zip(PAIRS, lines, keys, strict=True):
        gone = [bool(k) and times[k] >= 10 for k in ks]
        kept = "\n".join(x for x, g in zip(held, gone, strict=True) if not g)
        want.append((i, len(held), sum(gone), None if t is None else kept))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) == 24


def test_quality_counts_and_verdicts(docs):
    featured = quality.features(docs.select("doc_id", "text")).cache()
    judged = quality.judge(featured, quality.fit(featured)).collect()
    for r in judged:
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), brute_repeat_words(r.text))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.filter_quality(docs).columns == docs.columns


def test_quality_tells_junk_from_prose(spark):
    import random

    rng = random.Random(2)
    good = [(i, "\n".join(prose(rng, 25).capitalize() + "." for _ in range(4))) for i in range(300)]
    junk = [(1000 + i, " ".join(x + "***" for x in prose(rng, 60).split(" "))) for i in range(20)]
    junk += [(2000 + i, " ".join(x.upper() + "!!" for x in prose(rng, 60).split(" "))) for i in range(20)]
    kept = {r.doc_id for r in quality.filter_quality(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in good}


def brute_containment(texts, items):
    import regex

    def shingles(t):
        w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = set()
    for i, t in texts:
        for j, item in items:
            q = shingles(item)
            if q and len(q & shingles(t)) >= 0.8 * len(q):
                out.add((i, j, len(q & shingles(t)), len(q)))
    return out


def test_contamination_equals_brute_force(spark, docs):
    import random

    rng = random.Random(8)
    items = [(j, prose(rng, n)) for j, n in enumerate([5, 6, 9, 14, 30, 60, 60])] + [(7, None), (8, ""), (9, "too short"), (6, None)]
    texts = list(PAIRS)
    for j in range(7):
        w = items[j][1].split(" ")
        texts.append((100 + j, prose(rng, 3000) + " " + " ".join(w).replace("an", "AN").replace("é", "É") + "! " + prose(rng, 500)))
        w[len(w) // 2] = "other"
        texts.append((200 + j, prose(rng, 10) + ", " + " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r._id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contamination(df, bench).collect()}
    want = brute_containment(texts, items)
    assert got == want and len(want) >= 9
    hit = {i for i, *_ in want}
    left = decontamination.decontaminate(df.withColumn("_id", F.lit("x")), bench)
    assert left.columns == ["doc_id", "text", "_id"]
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(i or 0 for i, _ in texts if i not in hit)


def test_contamination_misses_stay_improbable():
    for n in (1, 8, 30, 200):
        extra = decontamination.extra_bits(n, 0.8, 1e-9)
        if extra == 62:
            continue
        load = 2.0**-extra
        assert (1 - (1 - np.exp(-load)) / load) ** np.ceil(0.8 * n) <= 1e-9


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards_hold_equal_counts_in_curve_order(docs, n_shards):
    df = docs.select("doc_id", "lang", F.length("text").alias("n_chars"), F.octet_length("text").alias("size"))
    got = sharding.hilbert_shards(df, ["lang", "n_chars"], n_shards, ["doc_id", "size"]).collect()
    assert len(got) == len(ROWS)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(ROWS)
    path = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert path == sorted(path)


def test_hilbert_index_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        axes = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n)])
        index = sharding.hilbert_index(axes, bits)
        assert sorted(index) == list(range(1 << (n * bits)))
        steps = np.abs(np.diff(axes[:, np.argsort(index)], axis=1)).sum(axis=0)
        assert (steps == 1).all()


def test_written_shards_prune(spark, tmp_path):
    rows = [(i, f"s{i % 9}", (i * 37) % 500) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    placed = sharding.hilbert_shards(df, ["source", "n"], 16, ["doc_id"])
    sharding.write_shards(df, placed, ["doc_id"], f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 900 and back.select("shard").distinct().count() == 16
    spans = back.groupBy("shard").agg((F.max("n") - F.min("n")).alias("w")).agg(F.avg("w")).first()[0]
    assert spans < 350


@pytest.mark.parametrize("carried", [True, False])
def test_written_shards_keep_null_and_repeated_ids(spark, tmp_path, carried):
    rows = [(None if i % 5 == 0 else 7 if i % 3 == 0 else i, f"s{i % 9}", (i * 37) % 500, f"text {i}") for i in range(600)]
    rows += [(7, "same", 1, "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, text string")
    placed = sharding.hilbert_shards(df.drop("text"), ["source", "n"], 16, ["doc_id"]).localCheckpoint()
    shards = placed if carried else placed.select("doc_id", "shard", "slot")
    sharding.write_shards(df, shards, ["doc_id"], f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(map(key, ((r.doc_id, r.source, r.n, r.text) for r in back))) == sorted(map(key, rows))
    slots = {}
    for r in back:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(40)) for s in slots.values())
    at = lambda r: key((r.doc_id, r.source, r.n) if carried else (r.doc_id,)) + (r.shard, r.slot)
    assert sorted(map(at, back)) == sorted(map(at, placed.collect()))


def test_shards_of_other_rows_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    for k, plan in enumerate(([(1, 0, 0), (None, 0, 1)], [(1, 0, 0), (1, 0, 1), (2, 0, 2)])):
        with pytest.raises(Exception, match="places in shards differ"):
            sharding.write_shards(df, spark.createDataFrame(plan, "doc_id long, shard int, slot long"), ["doc_id"], f"{tmp_path}/{k}")


def test_token_counts_against_offsets(docs):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    got = {}
    for r in token_counts.count_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {i: t for i, t in PAIRS if i is not None}
    assert set(got) == {i for i, t in texts.items() if t is not None}
    for i, held in got.items():
        held.sort(key=lambda r: r.section)
        text = texts[i]
        assert "".join(text[r.start : r.end] for r in held) == text and len(held) == text.count("\n") + 1
        ids = hf.encode(text, add_special_tokens=False)
        for rule in token_counts.RULES:
            assert abs(sum(r[f"tokens_{rule}"] for r in held) - len(ids.ids)) < 1e-6
        if text.isascii():
            starts = [a for a, _ in ids.offsets]
            assert [r.tokens_start for r in held] == [sum(r.start <= a < r.end for a in starts) for r in held]


def test_token_spans_of_long_runs():
    for text in ("a" * 300_000, " " * 300_000 + "x", "\n" * 50_000, "é" * 1000 + "\n😀"):
        starts, ends = token_counts.token_spans(text)
        assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] >= starts[:-1]).all()
    assert token_counts.attribute(np.array([0]), np.array([3]), np.array([0, 1]), 3, "largest").tolist() == [0, 1]
    assert token_counts.attribute(np.array([0]), np.array([4]), np.array([0, 1]), 4, "fraction").tolist() == [0.25, 0.75]


def test_empty_tables(none, spark):
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert quality.filter_quality(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert sharding.hilbert_shards(none.drop("shard"), ["lang"], 4, ["doc_id"]).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontamination.decontaminate(some, bench).count() == 1


