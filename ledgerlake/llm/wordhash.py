"""Words of Arrow text columns as 64-bit hashes, with numpy over the column's own buffers.

A word is a maximal run of bytes that the alphabet keeps; the alphabet also maps bytes before hashing
(lower case for A-Z). Both word definitions in use are decided byte by byte in UTF-8, because every byte
of a character above U+007F belongs to a word. Hashes are polynomial with random byte values, finished
with a 64-bit mixer; sequences of words are hashed the same way from the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE, _SEQ_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64),
                                                  np.cumprod(np.full(size - 1, b, np.uint64))])
                                  for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_BASE), Powers(_SEQ_BASE)


@dataclass(frozen=True)
class Alphabet:
    """keep: which bytes belong to words; value: what each byte counts in the hash."""

    keep: np.ndarray
    value: np.ndarray
    lower: bytes  # translation table for reading words back


@lru_cache(maxsize=None)
def alphabet(kind: str) -> Alphabet:
    """``space``: [^\\x20\\x09-\\x0D]+, as is. ``space_lower``: the same with A-Z lowered.
    ``alnum_lower``: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lowering A-Z."""
    code = np.arange(256)
    lower = code.copy()
    if kind != "space":
        lower[65:91] += 32
    if kind == "alnum_lower":
        keep = (lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122))
    else:
        keep = ~((code == 32) | ((code >= 9) & (code <= 13)))
    value = mix((lower.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    return Alphabet(keep, value, bytes(lower.astype(np.uint8)))


@dataclass(frozen=True)
class Words:
    """Words of rows ``first`` to ``first + len(bound) - 1``: hashes, byte places, and each row's first word."""

    first: int
    hashes: np.ndarray
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    bound: np.ndarray  # bound[i]:bound[i + 1] are row i's words
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bound) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bound))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each row (n + 1 values) and the bytes; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words(column: pa.Array, kind: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Word hashes of a text column, in chunks of whole rows of about ``chunk_bytes`` (one row at least)."""
    abc = alphabet(kind)
    off, data = _buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, n)
        part = data[off[lo]:off[hi]]
        rows = off[lo:hi + 1] - off[lo]
        keep = np.zeros(len(part) + 2, bool)
        keep[1:-1] = abc.keep[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[rows] = True
        start = np.flatnonzero(keep[1:] & (~keep[:-1] | edge))  # a row's first byte begins a word
        end = np.flatnonzero(keep[:-1] & (~keep[1:] | edge))
        up, down = _BYTES(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(abc.value[part] * up, out=total[1:])
        h = mix((total[end] - total[start]) * down[start]) if len(start) else np.zeros(0, np.uint64)
        yield Words(lo, h, start, end, np.searchsorted(start, rows), part)
        lo = hi


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes (also those that cross rows)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n] + np.uint64(size))
