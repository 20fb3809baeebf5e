"""Phrase collocation mining by stripes: each prefix keys an associative counter of the words that follow it.

Stripes are packed. The key of an entry is 64 bits: 24 of its prefix, then 40 of the whole phrase, so that in the order of
keys the entries of a prefix stand together as its stripe. A scan of the texts makes a run of stripes, with counts, of every
slice (about 6 bytes a distinct phrase), for all phrase lengths at once; the empty phrase counts all words. Runs are
dealt by prefix and phrase together, so that each stripe, above all that of the empty prefix, is spread over tasks, and merged
elementwise: counts of equal keys add up. Entries under ``least`` go.

In the merged stripes an entry is the count of an extension, that is of a phrase one word longer than its prefix, and the prefix's
total is its own entry one length before. The largest entry of a stripe tells whether an extension to the right subsumes the
prefix; the same entries keyed by the phrase without its first word give the extensions to the left. Longer phrases need no
look: one word more occurs at least as often.

What is left has no words yet. A second scan spells it: bitmaps by count tell tasks which keys are wanted and how frequent they
are, and a slice spells a key the more rarely the more frequent it is, so that each is spelled a few times at whatever size of the data. The few
that no slice has spelled are spelled by a third scan wherever they occur; it is left out if there are none.

Phrases are told apart by their 64 bits: of D distinct phrases one that is frequent shares its key with another with a chance of D / 2**64.

Defined results: texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into
words; phrases do not cross pieces. A null text is empty; a null language is ``und``. A row is a document: repeated rows
count each. Ids and other columns are not looked at. Texts of any length are taken whole. Empty in, empty out.
Scores are floor(2000000 a / (l + r)), in decimals of 38 digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrain.llm import wordhash
from cellgrain.llm.bitfilter import bitmap, passes
from cellgrain.llm.common import load, only, query, release, settle
from cellgrain.llm.tokens import Coded, byte_class, coded
from cellgrain.llm.wordhash import U, mix

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = byte_class((0, 255)) & ~_BREAK
_WORD[[0x20, 0x09]] = False
#: Bytes of text that are worked on together, and parts that keys are dealt to for each shuffle partition; a part is summed in one task.
SLICE, PARTS = 4 << 20, 8
#: Bits of a key that its prefix gives; how often a phrase is spelled on average; classes of counts, each four times the one before.
PREFIX_BITS, SPELLED, CLASSES = 24, 16, 10
_GOLDEN = U(0x9E3779B97F4A7C15)


def _by_language(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[str, Coded, np.ndarray]]:
    """Language, words, and hashes of the words by code."""
    for batch in batches:
        for part in wordhash.slices(batch, "text", slice_bytes):
            langs = part.column("lang").dictionary_encode()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                w = coded(part.column("text").filter(pa.array(np.asarray(langs.indices) == number)), _WORD)
                if len(w.code):
                    yield lang, w, np.array([xxhash.xxh64_intdigest(x) for x in w.words.to_pylist()], dtype=np.uint64)


def _phrases(w: Coded, spelled: np.ndarray, lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 0: the words that begin a phrase of that length, and the phrase's key."""
    piece = np.searchsorted(np.flatnonzero(_BREAK[w.data]), w.start) + w.row  # grows with each piece and text
    of = spelled[w.code]
    hashed = np.full(len(of), xxhash.xxh64_intdigest(lang.encode()), dtype=np.uint64)
    low = U(2 ** (64 - PREFIX_BITS) - 1)
    yield 0, np.arange(len(of)), mix(hashed)
    for length in range(1, min(longest, len(of)) + 1):
        n = len(of) - length + 1
        prefix = hashed[:n]
        hashed = mix(prefix * _GOLDEN + of[length - 1 :])
        at = np.flatnonzero(piece[:n] == piece[length - 1 :])
        yield length, at, (prefix[at] & ~low) | (hashed[at] & low)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits by planes of bytes, compressed: small ones take few bytes."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unplaned(held: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(held, 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _runs(batches: Iterator[pa.RecordBatch], longest: int, parts: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per slice and part a run of stripes: keys in order (as differences) with their counts."""
    for lang, w, spelled in _by_language(batches, slice_bytes):
        keys, counts = np.unique(np.concatenate([key for _, _, key in _phrases(w, spelled, lang, longest)]), return_counts=True)
        # the prefix's place turned by the phrase's: a stripe goes over all parts, and lies in order in each
        part = (((keys >> U(40)) * U(parts) >> U(24)) + (((keys >> U(16)) & U(0xFFFFFF)) * U(parts) >> U(24))) % U(parts)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(keys)).tolist()
        begins = [0, *ends[:-1]]
        yield pa.RecordBatch.from_pydict({
            "part": part[begins].astype(np.int32), "n": pa.array(np.subtract(ends, begins).astype(np.int32)),
            "keys": pa.array([_planes(np.diff(keys[a:b], prepend=U(0))) for a, b in zip(begins, ends, strict=True)], pa.binary()),
            "counts": pa.array([_planes(counts[a:b].astype(np.uint64)) for a, b in zip(begins, ends, strict=True)], pa.binary()),
        })


def _merged(table: pa.Table, least: int) -> pa.Table:
    """Entries of the stripes of one part, added up, of at least ``least``."""
    sizes = table["n"].to_pylist()
    keys = np.concatenate([np.cumsum(_unplaned(x, n)) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)])
    counts = np.concatenate([_unplaned(x, n) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(counts[order], first)
    held = total >= least
    return pa.table({"key": wordhash.signed(keys[first[held]]), "n": total[held].astype(np.int64)})


def _spelled(
    batches: Iterator[pa.RecordBatch], longest: int, wanted: np.ndarray, classes: list[tuple[np.ndarray, float]], slice_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Words of wanted phrases: n_words, lang, prefix, next, key. Each class has a bitmap and the share of slices that spell its phrases."""
    for lang, w, spelled in _by_language(batches, slice_bytes):
        words, slice_salt = w.words.cast(pa.string()), mix(spelled[w.code[:1]] + U(len(w.code)))
        for length, at, key in _phrases(w, spelled, lang, longest):
            held = passes(wanted, key << U(PREFIX_BITS))
            key, first = np.unique(key[held], return_index=True)
            at = at[held][first]
            if not len(key):
                continue
            lot = (mix(key ^ slice_salt) >> U(11)).astype(np.float64) * 2.0**-53
            drawn = np.zeros(len(key), dtype=bool)
            for bits, share in classes:
                some = np.flatnonzero(~drawn & (lot < share))
                drawn[some[passes(bits, key[some] << U(PREFIX_BITS))]] = True
            at, key = at[drawn], key[drawn]
            texts = [words.take(pa.array(w.code[at + k])) for k in range(length)] if len(key) else []
            empty = pa.array([""] * len(key), pa.string())
            yield pa.RecordBatch.from_pydict({
                "n_words": pa.array(np.full(len(key), length, dtype=np.int32)), "lang": pa.array([lang] * len(key), pa.string()),
                "prefix": pc.binary_join_element_wise(*texts[:-1], " ") if len(texts) > 1 else empty, "next": texts[-1] if texts else empty,
                "key": wordhash.signed(key),
            })


def frequent_stripes(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, n_words, prefix, next, phrase and n of the entries of the merged stripes; the empty phrase has 0 words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    spark = texts.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.mapInArrow(lambda x: _runs(x, longest, parts, SLICE), "part int, n int, keys binary, counts binary")
    entries = settle(runs.groupBy("part").applyInArrow(lambda t: _merged(t, least), "key long, n long"), "stripes")

    def spell(classes: list[tuple[DataFrame, float]], name: str) -> DataFrame:
        # bitmaps go by the first bits they are given, so they are given those of the phrase
        classes = [(keys.select(F.shiftleft("key", PREFIX_BITS)), share) for keys, share in classes]
        held = spark.sparkContext.broadcast([(bitmap(keys), share) for keys, share in classes])
        wanted = spark.sparkContext.broadcast(bitmap(_all(keys for keys, _ in classes)))
        found = texts.mapInArrow(
            lambda x: _spelled(x, longest, wanted.value, held.value, SLICE), "n_words int, lang string, prefix string, next string, key long"
        )
        return settle(found.distinct().join(entries, "key"), name)

    of_class = F.least(F.floor(F.log(F.col("n") / least) / math.log(4)), F.lit(CLASSES - 1))
    classes = [(entries.where(of_class == c).select("key"), min(1.0, SPELLED / (least * 4.0**c))) for c in range(CLASSES)]
    spelled = [spell(classes, "spelled")]
    missing = settle(entries.join(spelled[0].select("key"), "key", "left_anti").select("key"), "unspelled")
    if not missing.isEmpty():
        spelled.append(spell([(missing, 1.0)], "spelled-rest"))
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    out = settle(_all(spelled).distinct().select("lang", "n_words", "prefix", "next", phrase.alias("phrase"), "n"), "phrases")
    release(entries, missing, *spelled)
    return out


def _all(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, subsumed: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of 2 to ``longest`` words per language.

    A phrase goes if an extension by a word occurs in at least ``subsumed`` of 100 of its places.
    """
    stripes = frequent_stripes(docs, longest, least)
    entries = stripes.where("n_words > 0")
    found = entries.where("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = found.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w")), " ").alias("rest"),
    )
    cuts = cuts.join(entries.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(entries.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r) AS LONG)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    longer = entries.where("n_words > 2").select("lang", F.explode(F.array(
        F.col("prefix"), F.expr("substring_index(phrase, ' ', 1 - n_words)")
    )).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * subsumed)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = stripes.where("n_words = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "c.l", "c.r", "n", "c.score")


SQL = r"""
WITH p AS (
  SELECT doc_id, lang, row_number() OVER () AS piece, w FROM (
    SELECT doc_id, lang, [x FOR x IN string_split_regex(piece, '[ 	]+') IF x <> ''] AS w FROM (
      SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
    )
  ) WHERE len(w) > 0
), t AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
o AS (
  SELECT lang, w, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM t WINDOW s AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS m, w AS phrase FROM o
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM o WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM o WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM o WHERE w4 IS NOT NULL
), f AS (SELECT lang, m, phrase, count(*)::BIGINT AS a, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING a >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (
  SELECT x.lang, x.phrase, x.m, x.a, k.k, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a) // (l.a + r.a) AS score
  FROM f x JOIN (VALUES (1), (2), (3)) AS k(k) ON k.k < x.m
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k.k], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k.k + 1:], ' ')
), best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM f, (VALUES (2), (3)) AS s(k), (VALUES (1), (2), (3)) AS o(i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "lang", "text")
    return collocations(docs, longest=4, least=30, subsumed=80, top=2000)
