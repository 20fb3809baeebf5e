"""Words of whole Arrow text columns as dictionary codes: exact, without a loop over words.

A word is a run of bytes of one class; the classes used here are closed under UTF-8, so bytes can be read one by
one. All words of a slice lie end to end in one buffer, and Arrow makes the codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Coded:
    """Words of some rows in order: code, row and first byte of each, where each row's words begin, the words by code, the bytes."""

    code: np.ndarray
    row: np.ndarray
    first: np.ndarray  # one more entry than rows
    start: np.ndarray
    words: pa.Array
    data: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges, both ends included."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


def coded(column: pa.Array, inside: np.ndarray, spelled: np.ndarray | None = LOWER) -> Coded:
    """The words of every text; null counts as empty. ``inside`` tells the bytes of words, ``spelled`` how they are read."""
    offsets, data = text_bytes(column)
    held = inside[data]
    # a word begins and ends where the bytes change class, and at the edge of a text
    cut = np.ones(len(data) + 1, dtype=bool)
    if len(data):
        np.not_equal(held[1:], held[:-1], out=cut[1:-1])
    cut[offsets] = True
    start = np.flatnonzero(held & cut[:-1])
    end = np.flatnonzero(held & cut[1:]) + 1
    at = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=at[1:])
    kept = data[held]
    if spelled is not None:
        kept = spelled[kept]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Coded(np.asarray(words.indices), row, first, start, words.dictionary, data)
