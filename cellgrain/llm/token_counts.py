"""Token counts per section by offset-mapped attribution.

Every whole text is encoded once; the byte length of each token puts it at a character span. The spans are joined
with the sections of the text by interval, and a token that crosses a boundary is given to sections by a rule:

* ``start``: to the section of its first character,
* ``largest``: to the section that holds most of its characters, the earlier one on ties,
* ``fraction``: to every section by its share of the token's characters.

Counts of a text's sections always sum to the text's tokens. Both sides of the interval join are ordered lists of
the same row, so it is a merge by binary search inside an Arrow batch, without a shuffle and without exploding
tokens.

Defined results: a null text has no section; an empty one has one empty section. Sections must be contiguous, in
order, and cover the text; lines do. A token that ends inside a character begins at that character. A text of any
length is encoded whole. Rows are independent, so repeated rows agree. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm import wordhash
from cellgrain.llm.common import load, only, query

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "largest", "fraction")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The encoder and the byte length of every token; one per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(text: str) -> list[int]:
    """Where each line begins, in characters; a line keeps its end mark."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space of this length overflows the encoder's pattern matcher; such a run is a piece, encoded directly.
_LONG_SPACE = re.compile(_SPACE + "{20000,}")


def encode_whole(text: str, encoding) -> np.ndarray:
    """Token ids of a text of any length.

    A run of white space is one piece up to its last character, which may belong to the word after it, so the
    text can be cut there without changing a token.
    """
    ids, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return np.asarray(ids + encoding.encode_ordinary(text[at:]) if ids or at else encoding.encode_ordinary(text), dtype=np.int64)


def token_spans(text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every token of the whole text."""
    encoding, lengths = encoder(path, pattern)
    ids = encode_whole(text, encoding)
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) == len(text):
        return ends - lengths[ids], ends
    # characters begun before each byte; a span inside a character is moved to its first byte
    begun = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    starts = ends - lengths[ids]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = (data & 0xC0) == 0x80
    return begun[starts] - inside[starts], begun[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, n_chars: int, rule: str) -> np.ndarray:
    """Tokens of each section, by interval join of token spans with [sections[i], sections[i + 1])."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.maximum(np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1, first)
    counts = np.bincount(first[first == last] if rule != "start" else first, minlength=len(sections)).astype(np.float64)
    if rule == "start":
        return counts
    edges = np.append(sections, n_chars)
    for t in np.flatnonzero(first != last):  # the few tokens over a boundary
        held = np.arange(first[t], last[t] + 1)
        shares = np.minimum(edges[held + 1], ends[t]) - np.maximum(edges[held], starts[t])
        if rule == "largest":
            counts[held[int(np.argmax(shares))]] += 1
        else:
            counts[held] += shares / shares.sum()
    return counts


def count_tokens(
    docs: DataFrame, rules: tuple[str, ...] = RULES, sections: Callable[[str], list[int]] = line_sections,
    path: str = VOCABULARY, pattern: str = PATTERN,
) -> DataFrame:
    """One row per section: doc_id, section, start, end (characters), n_crossing, and tokens_<rule> for each rule."""
    if set(rules) - set(RULES):
        raise ValueError(f"rules are {RULES}")
    fields = "doc_id long, section int, start long, end long, n_crossing long, " + ", ".join(f"tokens_{r} double" for r in rules)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                ids, numbers, begins, stops, crossing = [], [], [], [], []
                totals: dict[str, list[np.ndarray]] = {r: [] for r in rules}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text is None:
                        continue
                    at = np.asarray(sections(text), dtype=np.int64)
                    if len(text):
                        starts, ends = token_spans(text, path, pattern)
                    else:
                        starts = ends = np.zeros(0, dtype=np.int64)
                    ids += [doc_id] * len(at)
                    numbers.append(np.arange(len(at), dtype=np.int32))
                    begins.append(at)
                    stops.append(np.append(at[1:], len(text)))
                    # a token crosses into a section whose first character lies inside it
                    over = np.searchsorted(starts, at, side="left") - np.searchsorted(ends, at, side="right")
                    crossing.append(np.maximum(over, 0))
                    for r in rules:
                        totals[r].append(attribute(starts, ends, at, len(text), r))
                if ids:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64()), "section": np.concatenate(numbers), "start": np.concatenate(begins),
                        "end": np.concatenate(stops), "n_crossing": np.concatenate(crossing).astype(np.int64),
                        **{f"tokens_{r}": np.concatenate(totals[r]) for r in rules},
                    })

    return only(docs, "doc_id", "text").mapInArrow(count, fields)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(load(spark, sf_dir, "documents"))
    return counts.select(
        "doc_id", "section", "start", "end", "n_crossing", F.col("tokens_start").cast("long"), F.col("tokens_largest").cast("long"),
        F.round("tokens_fraction", 6).alias("tokens_fraction"),
    )
