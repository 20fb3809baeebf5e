"""SentencePiece encoding and decoding over a relational lattice of pieces.

A text is cut into words at places that no piece spans. Per slice of an Arrow batch the distinct words that were not
met before are encoded together, each step on whole columns: their substrings of at most the longest piece's length
are exploded, equi-joined with the piece table by hash, the matches become edges (word, start, end, piece) grouped
by word, and a fold over each word's edges picks its path:

* a unigram table: Viterbi, the path of the greatest sum of scores;
* a BPE table: merges, each time the applicable edge of the best score, leftmost on ties. Sums of a BPE table's
  scores are no probabilities, and their Viterbi path is not what the table's own encoder returns; merging is.

Characters without a path become byte pieces, so decoding gives back any text but for U+2581, which pieces use for
the blank and which is read back as one. Results equal those of the ``sentencepiece`` library for both kinds.

A word table for the whole corpus is not built: it would have to be joined back to every word of every text. What a
worker keeps is bounded by CACHE words, and a text is never shuffled.

Defined results: a null text gives null ids, an empty one none. Rows are independent. Other columns pass.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.llm import wordhash
from cellgrain.llm.common import load, only, packed, packed_schema, query
from cellgrain.llm.wordhash import U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Words a worker remembers (about 150 bytes each); when it is full it starts anew.
CACHE = 200_000
#: Words of more characters are folded one by one.
LONG = 48
#: Low bits of a hash by which most substrings are seen not to be pieces.
_FILTER = (1 << 18) - 1
_MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
#: Blanks before letters, before anything else, or alone. Where a table's pieces don't fit, texts are cut at blanks only.
_FORMS = "²³¹¼-¾"  # of Latin-1; Python counts them as word characters
_WORD = rf" *[^\W\d_{_FORMS}]+| *(?:[^\w ]|[\d_{_FORMS}])+| +"
_AT_BLANKS = r" *[^ ]+| +"


@dataclass
class Model:
    kind: int
    pieces: dict[str, int]
    scores: np.ndarray
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    word: re.Pattern
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    cache: dict[str, bytes]

    @property
    def longest(self) -> int:
        return max(self.by_length)


def _model_type(proto: bytes) -> int:
    """trainer_spec (field 2) . model_type (field 3) of a serialised model; unigram where it is not set."""
    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 2:
                n = number()
                yield tag >> 3, data[at : at + n]
                at += n
            elif tag & 7 == 0:
                yield tag >> 3, number()
            else:
                at += 8 if tag & 7 == 1 else 4

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), UNIGRAM)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _substring_hashes(codes: np.ndarray):
    """A function of starts and one length, by a running polynomial over the code points."""
    n = len(codes)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + U(1)) * wordhash._power(_BASE, n), out=run[1:])
    back = wordhash._power(pow(_BASE, -1, 2**64), n + 1)
    return lambda starts, length: mix((run[starts + length] - run[starts]) * back[starts])


def model_of(pieces: list[tuple[int, str, float]], kind: int, bytes_of: list[bytes], byte_ids: np.ndarray, unknown: int) -> Model:
    """A model from (id, piece, score) of its ordinary pieces; a piece's blanks are U+2581."""
    table = {p.replace(_MARK, " "): i for i, p, _ in pieces}
    scores = np.full(len(bytes_of), -np.inf)
    for i, _, s in pieces:
        scores[i] = s
    word = re.compile(_WORD)
    if not all(word.fullmatch(p) for p in table):
        word = re.compile(_AT_BLANKS)
        if not all(word.fullmatch(p) for p in table):
            raise ValueError("a piece holds a blank after another character; texts can't be cut into words")
    by_length = {}
    for length in sorted({len(p) for p in table}):
        held = [p for p in table if len(p) == length]
        codes = _codes("".join(held))
        hashes = _substring_hashes(codes)(np.arange(0, len(codes), length), length)
        order = np.argsort(hashes)
        maybe = np.zeros(_FILTER + 1, dtype=bool)
        maybe[hashes & U(_FILTER)] = True
        by_length[length] = hashes[order], np.array([table[p] for p in held], dtype=np.int64)[order], maybe
    return Model(kind, table, scores, bytes_of, byte_ids, unknown, word, by_length, {})


@lru_cache(maxsize=2)
def read_model(path: str = MODEL, kind: int | None = None) -> Model:
    """The model of a file; one per Python worker."""
    import sentencepiece

    with open(path, "rb") as file:
        proto = file.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = sp.vocab_size()
    bytes_of, byte_ids, pieces = [], np.full(256, sp.unk_id(), dtype=np.int32), []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
        elif sp.is_unknown(i) or sp.is_control(i):
            bytes_of.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
        else:
            bytes_of.append(piece.replace(_MARK, " ").encode())
            pieces.append((i, piece, sp.get_score(i)))
    return model_of(pieces, kind or _model_type(proto), bytes_of, byte_ids, sp.unk_id())


# ---- lattice --------------------------------------------------------------------------------------------------
def lattice(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, end, piece) of the words laid end to end, ordered by start; word bounds; code points."""
    text = "".join(words)
    codes = _codes(text)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    hashed = _substring_hashes(codes)
    found = []
    at = np.arange(len(codes))
    for length, (hashes, ids, maybe) in model.by_length.items():
        starts = at[at + length <= stop]
        h = hashed(starts, length)
        held = maybe[h & U(_FILTER)]
        starts, h = starts[held], h[held]
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        held = hashes[place] == h
        found.append((starts[held], starts[held] + length, ids[place[held]]))
    start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((end, start))
    return start[order], end[order], piece[order], bounds, codes


def fold_merges(start, end, piece, bounds, scores) -> np.ndarray:
    """Whether each place between characters is a cut after all merges, for all words at once."""
    cut = np.ones(bounds[-1] + 1, dtype=bool)
    wide = np.flatnonzero(end - start > 1)
    word = np.searchsorted(bounds, start[wide], side="right") - 1
    # best score first, then leftmost, inside each word
    order = np.lexsort((start[wide], -scores[piece[wide]], word))
    edges, word = wide[order], word[order]
    while len(edges):
        s, e = start[edges], end[edges]
        count = np.cumsum(cut)
        inside = count[e - 1] - count[s]
        first = np.flatnonzero(cut[s] & cut[e] & (inside == 1))
        if not len(first):
            break
        first = first[np.unique(word[first], return_index=True)[1]]
        marks = np.flatnonzero(cut)
        cut[marks[np.searchsorted(marks, e[first]) - 1]] = False  # the only cut inside
        # an edge whose end lies inside another symbol never comes back
        keep = cut[s] & cut[e]
        keep[first] = False
        going = np.zeros(len(bounds), dtype=bool)
        going[word[first]] = True
        keep &= going[word]
        edges, word = edges[keep], word[keep]
    return cut


def fold_viterbi(start, end, piece, bounds, scores) -> np.ndarray:
    """Whether each place is a cut of the best path, for all words at once; a bare character costs ten below the least score."""
    n = bounds[-1]
    best, via = np.full(n + 1, -np.inf), np.zeros(n + 1, dtype=np.int64)
    best[bounds] = 0.0
    penalty = scores[np.isfinite(scores)].min() - 10.0
    bare = np.setdiff1d(np.arange(n), start[end - start == 1])
    s, e = np.concatenate([start, bare]), np.concatenate([end, bare + 1])
    gain = np.concatenate([scores[piece], np.full(len(bare), penalty)])
    offset = s - bounds[np.searchsorted(bounds, s, side="right") - 1]
    ends_word = np.zeros(n + 1, dtype=bool)
    ends_word[bounds] = True
    final = np.full(n + 1, -np.inf)
    order = np.argsort(e - s + offset, kind="stable")  # by the place in the word where the edge ends
    level = (e - s + offset)[order]
    cuts = np.searchsorted(level, np.arange(level.max(initial=0) + 2))
    for k in range(1, len(cuts) - 1):
        held = order[cuts[k] : cuts[k + 1]]
        reach = best[s[held]] + gain[held]
        np.maximum.at(final, e[held], reach)
        won = held[reach == final[e[held]]]
        # equal sums: the longer edge, as it is met first from the left
        won = won[np.argsort(-s[won], kind="stable")]
        via[e[won]] = s[won]
        inner = e[won][~ends_word[e[won]]]
        best[inner] = final[inner]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    here = bounds[1:].copy()
    floor = bounds[:-1]
    while len(here):
        here = via[here]
        on = here > floor
        here, floor = here[on], floor[on]
        cut[here] = True
    return cut


def _merge_long(word: str, model: Model) -> list[str]:
    """Merges of one long word with a heap: n log n instead of a round per merge."""
    part = list(word)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(part) and (piece := model.pieces.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (-model.scores[piece], i, part[i] + part[j]))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, ""
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in part if p]


def _ids(symbol: str, model: Model) -> np.ndarray:
    piece = model.pieces.get(symbol)
    if piece is not None:
        return np.array([piece], dtype=np.int32)
    if (model.byte_ids == model.unknown).all():
        return np.array([model.unknown], dtype=np.int32)
    return model.byte_ids[np.frombuffer(symbol.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def encode_words(words: list[str], model: Model) -> list[bytes]:
    """The ids of each distinct word as int32 bytes."""
    out: dict[str, bytes] = {}
    short = [w for w in words if len(w) <= LONG or model.kind == UNIGRAM]
    for w in words:
        if len(w) > LONG and model.kind == BPE:
            out[w] = np.concatenate([_ids(p, model) for p in _merge_long(w, model)]).tobytes()
    if short:
        start, end, piece, bounds, codes = lattice(short, model)
        fold = fold_merges if model.kind == BPE else fold_viterbi
        cut = np.flatnonzero(fold(start, end, piece, bounds, model.scores))
        # the chosen path's edges, found by their start and end
        keys, wanted = start * 32 + (end - start), cut[:-1] * 32 + np.diff(cut)
        order = np.argsort(keys)
        place = np.minimum(np.searchsorted(keys[order], wanted), max(len(keys) - 1, 0))
        known = keys[order][place] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
        ids = np.where(known, piece[order][place] if len(keys) else 0, -1).astype(np.int32)
        first = np.searchsorted(cut, bounds).tolist()
        whole, unknown = ids.tobytes(), np.concatenate([[0], np.cumsum(ids < 0)])[first].tolist()
        text = "".join(short) if unknown[-1] else ""
        for i, w in enumerate(short):
            a, b = first[i], first[i + 1]
            if unknown[i] == unknown[i + 1]:
                out[w] = whole[4 * a : 4 * b]
            else:
                ends = cut[a : b + 1].tolist()
                out[w] = b"".join(
                    p.tobytes() if p >= 0 else _ids(text[x:y], model).tobytes() for p, x, y in zip(ids[a:b], ends[:-1], ends[1:], strict=True)
                )
    return [out[w] for w in words]


def encode_texts(texts: list[str | None], model: Model) -> list[np.ndarray | None]:
    """Ids of each text."""
    cut = [None if t is None else model.word.findall(" " + t.replace(_MARK, " ")) if t else [] for t in texts]
    held = model.cache
    new = [w for w in {w for words in cut if words for w in words} if w not in held]
    if len(held) + len(new) > CACHE:
        held.clear()
        new = list({w for words in cut if words for w in words})
    for at in range(0, len(new), 10_000):
        some = new[at : at + 10_000]
        held.update(zip(some, encode_words(some, model), strict=True))
    return [None if words is None else np.frombuffer(b"".join(map(held.__getitem__, words)), dtype=np.int32) for words in cut]


def decode_ids(ids: np.ndarray, model: Model) -> str:
    """The text of ids: pieces and bytes joined, the blank that encoding put before the text taken off."""
    text = b"".join(map(model.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")


# ---- Spark jobs -----------------------------------------------------------------------------------------------
def encode(docs: DataFrame, path: str = MODEL, kind: int | None = None, with_decoded: bool = False) -> DataFrame:
    """``docs`` packed to doc_id, text and _row, with token_ids, and their text read back if asked for. No shuffle.

    Reading back in the same pass keeps one Python worker per task instead of two.
    """
    held = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(path, kind)
        for batch in batches:
            for part in wordhash.slices(batch, "text", 1 << 19):
                ids = encode_texts(part.column("text").to_pylist(), model)
                out = part.append_column("token_ids", pa.array(ids, pa.list_(pa.int32())))
                if with_decoded:
                    out = out.append_column("decoded", pa.array([None if x is None else decode_ids(x, model) for x in ids], pa.string()))
                yield out

    added = [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return held.mapInArrow(run, packed_schema(held, *added[: 1 + with_decoded]))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with the column decoded: the texts of token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(path)
        for batch in batches:
            texts = [decode_ids(np.asarray(x.values), model) if x.is_valid else None for x in batch.column("token_ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


@query("op6_piece_lattice")
def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    coded = encode(docs, with_decoded=True)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
