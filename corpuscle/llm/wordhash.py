"""Words, shingles and their 64-bit hashes over whole Arrow batches.

All functions work on the raw UTF-8 bytes of an Arrow string column with NumPy; no Python
string is made for a word. Words are runs of bytes other than space and 0x09-0x0D; A-Z count
as a-z. A batch is walked in chunks of whole texts of about ``CHUNK`` bytes, which bounds the
memory; a text larger than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _R) | np.uint64(1)
    t[65:91] = t[97:123]
    return t


_VALUES = _byte_values()
#: Bytes outside words: white space; and all but letters, digits and bytes of other scripts.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK + (1 << 16)), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[int(base)] = held
    return held[:n]


@dataclass
class Words:
    """first: row of the batch; offsets: each row's words are offsets[i]:offsets[i+1]; start, end: bytes in ``data``."""

    first: int
    data: np.ndarray
    row_bytes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    total: np.ndarray

    def lead(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes, at most the whole word."""
        return mix((self.total[np.minimum(self.start + n, self.end)] - self.total[self.start]) * powers(_RINV, len(self.total))[self.start] + np.uint64(n))

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def pieces(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(column: pa.Array, outside: np.ndarray = SPACE) -> Iterator[Words]:
    data, offs = raw(column)
    for lo, hi in pieces(offs):
        b, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        n = len(b)
        if not n:
            z = np.zeros(0, np.int64)
            yield Words(lo, b, o, np.zeros(hi - lo + 1, np.int64), z, z, np.zeros(0, np.uint64), np.zeros(1, np.uint64))
            continue
        inside = ~outside[b]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[o[o < n]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[o[o > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUES[b] * powers(_R, n), out=total[1:])
        h = mix((total[end] - total[start]) * powers(_RINV, n)[start])
        yield Words(lo, b, o, np.searchsorted(start, o), start, end, h, total)


class Runs:
    """Hashes of any run of consecutive words in O(1) each."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(h * powers(_R, n), out=self.total[1:])
        self.back = powers(_RINV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a text of fewer, but not none, is one shingle."""
    n = np.diff(w.offsets)
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(w.rows), per)
    begin = np.repeat(w.offsets[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    return Runs(w.hash).of(begin, np.minimum(begin + k, w.offsets[1:][row])), row
