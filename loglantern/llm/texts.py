"""Texts as flat byte arrays: what the numpy operators of this folder share.

A slice of an Arrow column is seen as one ``uint8`` array and the offsets of its rows, so that words, lines
and hashes of all rows of the slice are found in whole-array steps. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes worked on at a time. Longer single texts make a slice of their own.
SLICE_BYTES = 1 << 20

# White space that parts words: [\x20\x09-\x0D]. Fixed values.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def byte_slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of slices of about ``slice_bytes``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type)) if column.null_count else column
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base of the hashes, or of its inverse."""
    known = _powers.get(inverse)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 2 * SLICE_BYTES:  # what single long texts need isn't kept
            _powers[inverse] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power: hashes of all substrings come from two entries each."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they start."""
    raw = (sums[ends] - sums[starts]) * powers(len(sums), True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_row(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Totals by row of a running sum that starts with 0."""
    return sums[offsets[1:]] - sums[offsets[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words lie before each offset."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]
