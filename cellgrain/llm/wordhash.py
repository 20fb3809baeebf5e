"""Words of whole Arrow text columns and their hashes, without a loop over words.

The words of a text are its runs of bytes other than 0x20 and 0x09-0x0D; as these are ASCII, UTF-8 can be read byte by
byte. Each distinct word of a slice is hashed once, with 128 bits of XXH3, of which a lane is one half. Windows of words
are sums of their words' hashes, each times a random odd number of its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from cellgrain.llm.tokens import byte_class, coded, text_bytes

U = np.uint64
#: Bytes of text that are looked at together; bounds the working arrays (about 60 bytes each per byte of text).
SLICE_BYTES = 1 << 20
#: The longest window.
MAX_WINDOW = 4096
_INSIDE = ~(byte_class((0x09, 0x0D)) | byte_class((0x20, 0x20)))
_PLACE = np.random.default_rng(20240229).integers(1, 2**63, (2, MAX_WINDOW), dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE_BYTES + 1), base & (2**64 - 1), dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some rows in order: row and hashes (one per lane) of each, and where each row's words begin."""

    row: np.ndarray
    first: np.ndarray  # one more entry than rows
    hashes: np.ndarray  # lanes x words


def words(column: pa.Array) -> Words:
    """The words of every text with two hashes each, halves of one of 128 bits."""
    w = coded(column, _INSIDE, None)
    digests = b"".join(map(xxhash.xxh3_128_digest, w.words.to_pylist()))
    lanes = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
    hashes = np.empty((2, len(w.code)), dtype=np.uint64)
    for lane in range(2):
        np.take(np.ascontiguousarray(lanes[:, lane]), w.code, out=hashes[lane])
    return Words(w.row, w.first, hashes)


def sequences(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128-bit hashes, as rows of two, of the words from ``first`` up to ``last`` in order."""
    pairs = np.ascontiguousarray(w.hashes.T)
    digests = b"".join(xxhash.xxh3_128_digest(pairs[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist(), strict=True))
    return np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)


def windows(hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each word on, across rows too; the caller leaves those out."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out += _PLACE[lane, k] * hashes[k : k + n]
    return mix(out)


def least_of(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of the ``span`` hashes from each one on, the leftmost on ties."""
    value, place, width = hashes, np.arange(len(hashes)), 1
    while width < span and len(value) > 1:
        step = min(width, span - width)  # the last two stretches may overlap
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value, width = np.minimum(value[:-step], value[step:]), width + step
    return place


def starts_inside(w: Words, length: int) -> np.ndarray:
    """Word numbers from which ``length`` words of one row follow."""
    n = max(0, len(w.row) - length + 1)
    return np.flatnonzero(w.row[:n] == w.row[length - 1 : length - 1 + n]) if n else np.zeros(0, dtype=np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one longer text is a part of its own."""
    offsets, _ = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
