"""Whole queries and the pipeline against plain Python over the smallest tables."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

import corpus_pipeline
from cellgrain.llm import QUERIES, piece_lattice, quality, sharding
from helpers import awkward_rows, brute_classes, brute_repeat_words, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# ---- quality rules --------------------------------------------------------------------------------------------
def plain_features(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": brute_repeat_words(text),
        "n_upper": len(regex.findall(r"\p{Lu}", text)), "n_letters": len(regex.findall(r"\p{L}", text)),
        "n_shouts": text.count("!"), "n_bars": text.count("|"), "n_lines": len(lines),
        "n_closed_lines": sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?…" for x in lines),
    }


def plain_votes(f):
    def vote(good, bad):
        return 0 if bad else 1 if good else None

    n, chars, sym, lines = f["n_words"], f["word_chars"], f["n_symbols"], f["n_lines"]
    return (
        vote(n >= 50, n < 10), vote(3 * n <= chars <= 12 * n, not 2 * n <= chars <= 20 * n), vote(50 * sym <= n, 5 * sym > n), vote(10 * sym <= n, sym > n),
        vote(10 * f["n_upper"] <= f["n_letters"], 3 * f["n_upper"] > f["n_letters"]), vote(50 * f["n_shouts"] <= n, 10 * f["n_shouts"] > n),
        vote(50 * f["n_bars"] <= n, 10 * f["n_bars"] > n), vote(10 * f["n_dup_lines"] <= lines, 2 * f["n_dup_lines"] > lines),
        vote(20 * f["n_repeat_words"] <= n, 5 * f["n_repeat_words"] > n), vote(10 * f["n_closed_lines"] >= 7 * lines, 10 * f["n_closed_lines"] < 3 * lines),
    )


def plain_em(patterns, rounds=20):
    """Posterior of each pattern (votes: count) after expectation-maximisation, from the description in the module."""
    p = {}
    for v in patterns:
        against = sum(x == 0 for x in v)
        p[v] = 0.95 if against == 0 else 0.3 if against == 1 else 0.05
    for _ in range(rounds):
        total = sum(patterns.values())
        good, bad = sum(n * p[v] for v, n in patterns.items()), sum(n * (1 - p[v]) for v, n in patterns.items())
        chances = []
        for k in range(10):
            said = {(c, x): sum(n * (p[v] if c else 1 - p[v]) for v, n in patterns.items() if v[k] == x) for c in (0, 1) for x in (0, 1)}
            share = lambda c, x: (said[c, x] + 0.1) / ((good if c else bad) + 0.3)  # noqa: B023, E731
            g = share(1, 1), min(share(1, 0), 0.2)
            b = share(0, 1), max(share(0, 0), 4 * g[1])
            over = max(1.0, sum(b) / 0.999)
            chances.append((g, (b[0] / over, b[1] / over)))
        prior = min(max(good / total, 0.3), 0.99)
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for x, (g, b) in zip(v, chances, strict=True):
                odds += math.log((1 - sum(g)) / (1 - sum(b))) if x is None else math.log(g[1 - x] / b[1 - x])
            p[v] = 1 / (1 + math.exp(-odds))
    return p


def plain_quality(texts):
    """(features, base_failed, p_good) of each text."""
    found = [plain_features(t) for t in texts]
    voted = [plain_votes(f) for f in found]
    p = plain_em(Counter(voted))
    return [(f, f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"], p[v]) for f, v in zip(found, voted, strict=True)]


def test_quality_query_equals_a_plain_version(spark):
    docs = table("documents")
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    kept = 0
    for d, (f, failed, p) in zip(docs, plain_quality([d["text"] for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert all(r[c] == f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.base_failed == failed and r.p_good == pytest.approx(p, abs=1e-6)
        assert r.kept == (not failed and p >= 0.5)
        kept += r.kept
    assert 0.5 * len(docs) < kept < len(docs)


def test_quality_votes_and_posteriors_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(900 + i, t) for i, t in enumerate([
        "ALL CAPS HERE! " * 20, "a | b | c\n" * 12, "### " * 40, "x" * 400 + " y", "Line.\n" * 30, "no end\n" * 3 + "Ends here!\r\n", "tiny", "é É ß ẞ 日本. " * 15])]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    featured = quality.features(df)
    judged = {r.doc_id: r for r in quality.judge(featured, quality.fit(featured)).collect()}
    voted = {r.doc_id: tuple(r[f"_vote_{n}"] for n in quality.rules()) for r in quality.votes(featured).collect()}
    for k, (f, failed, p) in enumerate(plain_quality([t for _, t in rows])):
        assert {c: judged[k][c] for c in quality.FEATURES} == f, rows[k]
        assert voted[k] == plain_votes(f)
        assert judged[k].base_failed == failed and judged[k].p_good == pytest.approx(p, abs=1e-6)


# ---- shards ---------------------------------------------------------------------------------------------------
def test_shards_query_equals_a_plain_version(spark):
    docs = table("documents")

    def ordinals(values):
        if not isinstance(next(v for v in values if v is not None), str):
            return [None if v is None else float(v) for v in values]
        shared = os.path.commonprefix([v for v in values if v is not None]).encode()
        return [None if v is None else float(int.from_bytes((v.encode()[len(shared):] + bytes(6))[:6])) for v in values]

    cells = []
    for name in ("source", "lang", "n_chars"):
        x = ordinals([d[name] for d in docs])
        held = sorted(v for v in x if v is not None)
        limits = sorted({held[max(0, math.ceil(k / 32 * len(held)) - 1)] for k in range(1, 32)})[:30]
        cells.append([0 if v is None else 1 + sum(v >= limit for limit in limits) for v in x])
    place = sharding.hilbert_index(np.array(cells), 5)
    low = lambda v: (v is not None, v)
    rows = []
    for d, h in zip(docs, place.tolist(), strict=True):
        data = (d["text"] or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data) if d["text"] is not None else 0
        rows.append((h, low(d["doc_id"]), crc, size, d["doc_id"]))
    rows.sort(key=lambda r: r[:4])
    want, used = {}, Counter()
    for rank, (h, _, crc, size, doc_id) in enumerate(rows):
        shard = rank * 40 // len(rows)
        want[doc_id] = (size, crc, "rows", shard, used[shard], None, h)
        used[shard] += 1
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard, r.hilbert) for r in QUERIES["op3_hilbert_shards"](spark, SF).collect()}
    assert got == want


# ---- pipeline -------------------------------------------------------------------------------------------------
def plain_lines(docs):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {i: (t or "").split("\n") for i, t in docs.items()}
    times = Counter(k for held in split.values() for k in {x.strip(strip).translate(lower) for x in held})
    return {i: t if t is None else "\n".join(x for x in split[i] if not (k := x.strip(strip).translate(lower)) or times[k] < 10) for i, t in docs.items()}


def plain_shingles(text):
    w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_equals_a_plain_version_row_by_row(spark):
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    judged = zip(docs.items(), plain_quality(list(docs.values())), strict=True)
    docs = {i: t for (i, t), (_, failed, p) in judged if not failed and p >= 0.5}
    docs = plain_lines(docs)
    classes = brute_classes(list(docs.items()))
    docs = {i: t for (i, t), c in zip(docs.items(), classes, strict=True) if i == c or not words(t)}
    items = [s for s in (plain_shingles(b["text"]) for b in table("benchmark")) if s]
    docs = {i: t for i, t in docs.items() if not any(len(s & plain_shingles(t)) >= 0.8 * len(s) for s in items)}
    rows = corpus_pipeline.run(spark, SF)
    got = {r.doc_id: (r.decoded, r.n_tokens, len(r.token_ids)) for r in piece_lattice.decode(rows).collect()}
    assert got.keys() == docs.keys() and len(got) < len(table("documents"))
    for i, (text, n, n_ids) in got.items():
        assert text == docs[i] and n == n_ids
