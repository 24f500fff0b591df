"""Vectorised helpers over the UTF-8 bytes of Arrow text columns (NumPy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """``(first_row, bytes, offsets)`` of consecutive rows holding about ``limit``
    bytes (one row at least; a longer text is a block of its own).  Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, content[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest list of each base is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.empty(1 << max(n - 1, 1).bit_length(), np.uint64)
        known[0] = done = 1
        while done < len(known):
            known[done:2 * done] = known[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = known
    return known[:n]


BASE = 0x9E3779B97F4A7C15 | 5
STEP = 0xD6E8FEB86659FD93
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(codes: np.ndarray, base: int) -> np.ndarray:
    """Sums of codes[j] * base^j before each position (one longer than ``codes``)."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(base, len(codes)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each range, equal for equal content."""
    inverse = pow(base, -1, 1 << 64)
    n = len(sums)
    return mix((sums[ends] - sums[starts]) * powers(inverse, n)[starts])


def words(content: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """``(starts, ends, row)`` of the runs of word bytes; runs end with their row."""
    inside = is_word[content]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(content))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(_CODES[content], BASE), starts, ends, BASE)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries (row limits are the caller's)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return range_hash(prefix_hash(hashes, STEP), at, at + n, STEP)


#: a-z for A-Z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
