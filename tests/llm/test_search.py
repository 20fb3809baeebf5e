"""Ranked search, phrase mining and URL rules against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgrain.llm import collocations, lexical_search, url_filter
from cellgrain.llm.url_filter import Pattern, Rule
from helpers import SCHEMA, awkward_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def key(x):
    return tuple((v is not None, v) for v in x)


# ---- ranked search --------------------------------------------------------------------------------------------
def brute_ranking(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in dict.fromkeys(items):
        wanted, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, t in terms:
            tf, score = Counter(t), 0
            for x in wanted & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (1000000000 * tf[x] // (1000 * tf[x] + 8 * (100 - 90 + 90 * len(t) * n_docs // length)))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=key)


def search_rows():
    rng = random.Random(11)
    docs = [(i, t) for i, t, *_ in awkward_rows()]
    docs += [(100 + i, prose(rng, rng.randint(1, 80)).replace(" ", rng.choice([" ", ", ", "_", "-"]))) for i in range(120)]
    docs += [(300 + i, "tie of equal scores") for i in range(30)] + [(300, "tie of equal scores"), (None, "tie of equal scores")]
    items = [(j, prose(rng, rng.randint(1, 30))) for j in range(70)]
    items += [(80, "TIE scores"), (80, "TIE scores"), (80, "another text of that id, scores"), (81, None), (82, ""), (83, "…, nowhere"), (None, "equal"), (84, "日本語 ÄÖ tie")]
    return docs, items


@pytest.mark.parametrize("tiles", [(32, 1 << 22, 2**53, 500_000), (3, 40, 3 * 10**10, 500_000), (32, 1 << 22, 2**53, 30)])
def test_ranking_equals_brute_force(spark, monkeypatch, tiles):
    """As it is; with tiles and strips of a few cells; with items in several blocks."""
    for name, value in zip(("TILE_ITEMS", "TILE_CELLS", "EXACT", "BLOCK_TERMS"), tiles, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = search_rows()
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, `a.b` int")
    got = lexical_search.rank_documents(table, spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=key) == brute_ranking(docs, items, 10)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert lexical_search.rank_documents(docs, items).count() == 0
    some = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert lexical_search.rank_documents(some, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(some, items).count() == 1  # N = df = 1: the weight is 287


def test_kept_best_of_slices_are_tie_safe():
    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 6, 5000), rng.permutation(5000)
    best = lexical_search._Best(10)
    for lo in range(0, 5000, 700):
        best.take(score[lo : lo + 700], ids[lo : lo + 700])
    want = sorted(zip((-score).tolist(), ids.tolist(), strict=True))[:10]
    assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want


# ---- phrases --------------------------------------------------------------------------------------------------
def brute_phrases(rows, least, subsumed, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, held in f.items():
        frequent = {p: a for p, a in held.items() if a >= least and len(p) > 1}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, _, left, right = min((2000000 * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(7)
    vocabulary = [prose(rng, 1) for _ in range(12)] + ["don't", "x-1", "日本語", "\x00odd", "a\u00a0b"]
    rows = [("en", "The quick brown fox jumps. " * 12), ("en", None), (None, "no language here, no language there. " * 9), ("und", "no language here"), ("de", "")]
    for i in range(200):
        words = [rng.choice(vocabulary).title() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "de", "fr"]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "!? "]) for w in words)))
    rows += [("en", "ends with a frequent prefix the quick")] * 15
    rows += [("en", "hot passage of a third of all rows")] * 100
    return rows


@pytest.mark.parametrize(("least", "subsumed", "top", "spelled"), [(5, 80, 2000, 16), (10, 50, 7, 0.5), (1, 80, 100, 16), (5, 80, 2000, 0.001)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, subsumed, top, spelled):
    """With slices of a few texts, and with phrases that the first spelling misses."""
    monkeypatch.setattr(collocations, "SLICE", 2000)
    monkeypatch.setattr(collocations, "SPELLED", spelled)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, phrase string")
    got = collocations.collocations(docs, 4, least, subsumed, top).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, least, subsumed, top)


def test_stripes_hold_every_frequent_phrase_once(spark):
    rows = phrase_rows()
    held = collocations.frequent_stripes(spark.createDataFrame(rows, "lang string, text string"), 3, 5).collect()
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            want[lang or "und", ""] += len(w)
            want.update((lang or "und", " ".join(w[i : i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    assert sorted((r.lang, r.phrase, r.n) for r in held) == sorted((*k, n) for k, n in want.items() if n >= 5)
    assert all(r.n_words == len(r.phrase.split(" ")) if r.phrase else r.n_words == 0 for r in held)


def test_phrases_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " \t")], "lang string, text string")).count() == 0


def test_packed_numbers_come_back():
    for x in (np.zeros(0, np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64), np.arange(1000, dtype=np.uint64)):
        assert (collocations._unplaned(collocations._planes(x), len(x)) == x).all()


# ---- urls -----------------------------------------------------------------------------------------------------
URLS = [
    "https://www.example.com/en/1", "http://a.b.EXAMPLE.com/en/", "http://example.com/EN/x", "http://example.com/en", "http://example.com", "http://example.com?x=/en/",
    "http://notexample.com/en/1", "https://x.net/es/a#b", "https://x.net/fr/", "https://x.net/de/adult/", "https://ads-track.x.org/", "https://x.org/cheap//pills.html",
    "https://x.org/cheappills", "https://x.org/adult-education/1", "https://adults.org/", "https://x.org/Casino", "ftp://h/a?b", "no scheme net/es/", "", None, "://", "x://://y",
    "http://user@x.com:80/en/", "http://com/", "http://a\nb.com/", "http://x/y.com/", "http://x.org/" + "long/" * 20_000 + "viagra", "http://x.org/?viagra",
]


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = re.split("[?#]", url[url.index("://") + 3 :], maxsplit=1)[0]
        cut = rest.find("/") if "/" in rest else len(rest)
        host, path = rest[:cut].translate(LOWER), rest[cut:]
    fitting = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fitting:
        best = max(fitting, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    text = (host + path.translate(LOWER))
    found = []
    for p in url_filter.PATTERNS:
        words = p.text.strip("^").split("^")
        if re.search("(^|[^a-z0-9])" + "[^a-z0-9]+".join(words) + "([^a-z0-9]|$)", text):
            found.append(p)
    return host, path, None, max(found, key=lambda p: len(p.text)).verdict if found else "allow"


def test_urls_equal_a_plain_version(spark):
    rows = [(None if i == 3 else i % 20, u, "kept", "kept") for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, `my col` string")
    judged = url_filter.judge_urls(pages)
    assert judged.columns == ["page_id", "url", "verdict", "my col", "host", "path", "rule"]
    got = [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict, r["my col"]) for r in judged.collect()]
    want = [(i, u, *plain_verdict(u), "kept") for i, u, *_ in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    allowed = url_filter.filter_urls(pages)
    assert allowed.columns == pages.columns
    assert sorted(map(key, (tuple(r) for r in allowed.collect()))) == sorted(map(key, (r for r in rows if plain_verdict(r[1])[3] == "allow")))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, (), ()).collect()} == {"allow"}


def test_rules_stand_under_their_rarest_token():
    rules = [Rule("block", "ads.example.com", "/x/"), Rule("block", "com", "/pre"), Pattern("block", "^two^words^"), Pattern("block", "part*"), Pattern("block", "^a*b^")]
    assert [r.tokens() for r in rules] == [{"ads", "example", "com", "x"}, {"com"}, {"two", "words"}, set(), set()]
    found = url_filter.index(rules, {"ads": 5, "example": 9, "com": 100, "x": 7, "two": 3, "words": 1})
    assert found == {"ads": [0], "com": [1], "words": [2], "": [3, 4]}
    assert url_filter.candidates(found, "example.com", "/words/") == [1, 2, 3, 4]


def test_candidates_hold_every_rule_that_fits():
    rng = random.Random(5)
    hosts = [".".join(rng.choice(["a", "b", "ads", "shop", "com", "net"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    paths = ["/" + "/".join(rng.choice(["en", "x", "item-1", "buy.now", ""]) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    rules = [Rule("block", rng.choice(hosts), rng.choice(paths)[: rng.randint(0, 6)]) for _ in range(200)]
    rules += [Pattern("block", rng.choice(["^{}^", "{}", "^{}", "*{}*", "{}^x"]).format(rng.choice(["ads", "en", "buy^now", "item-1"]))) for _ in range(40)]
    found = url_filter.index(rules, {})
    for host, path in zip(hosts, paths, strict=True):
        fetched = set(url_filter.candidates(found, host, path))
        for i, r in enumerate(rules):
            fits = re.match(r.regex(), host + path) if isinstance(r, Rule) else re.search(r.regex(), host + path.lower())
            if isinstance(r, Rule):
                assert bool(fits) == ((host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
            assert not fits or i in fetched


def test_token_counts_of_rules(spark):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    counts = url_filter.token_counts(urls, url_filter.RULES)
    assert counts["net"] == 3 and counts["example"] == 6


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_collocations", "op13_url_rules"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from cellgrain.llm import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(key, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(key, want.fetchall()))
