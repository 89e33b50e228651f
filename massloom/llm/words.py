"""Hashes of the words of whole Arrow batches, computed by numpy on the UTF-8 bytes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, after A-Z are lower-cased.
A word's hash is a polynomial over random 64-bit values of its bytes, so that one
running sum over a batch gives the hashes of all words in it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone, as a whole. Its arrays have 8 bytes a byte, and
#: small ones go back to the system when freed, so that workers stay small over many tasks.
BLOCK_BYTES = 1 << 18
#: Bytes of text for which powers are kept.
KEPT_POWERS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= KEPT_POWERS + 1:
            _powers[name] = known
    return known


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows (rows + 1)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes together."""
    n = len(column)
    if n:
        _, ends = string_bytes(column)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
            yield a, min(b, n)
            a = min(b, n)


def word_hashes(column: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each row: rows + 1 values) of a column without nulls.

    letters: words are runs of ASCII letters and bytes beyond ASCII instead.
    """
    data, ends = string_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    word = ~(_NO_LETTER if letters else _SPACE)[data]
    new_row = np.zeros(n + 1, bool)
    new_row[ends] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | new_row[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | new_row[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("p", _P, n)[:n], out=running[1:])
    h = (running[b] - running[a]) * _power("i", _P_INVERSE, n)[a]
    return mix(h), np.searchsorted(a, ends)


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes, case and all."""
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_EXACT[data] * _power("p", _P, n)[:n], out=running[1:])
    return mix((running[end] - running[begin]) * _power("i", _P_INVERSE, n)[begin])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs before each row) in row order; rows with fewer words have none."""
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    at = np.arange(ends[-1]) + np.repeat(rows[:-1] - ends[:-1], counts)
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total += words[at + i] * _SHINGLE[i]
    return mix(total), ends


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words as a whole."""
    return mix((words * _SHINGLE[32 : 32 + len(words)]).sum(keepdims=True) + np.uint64(len(words)))[0]


def give_back() -> None:
    """Return freed memory to the system at a task's end: idle workers stay and count as their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
