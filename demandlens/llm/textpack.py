"""Vectorised work on whole Arrow text columns inside tasks (no per-character Python).

A text batch is read straight from its Arrow buffers as bytes.  Words are found with a
256-entry byte table (0 = separator, else the byte the word is hashed with), and any byte
range is hashed in constant time from prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_X = 0x9E3779B97F4A7C15 | 1
_XINV = pow(_X, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = _tables
    if "p" not in tables or len(tables["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = _tables if size == CHUNK_BYTES + 1 else {}  # those for a longer text go with it
        for key, base in (("p", _X), ("i", _XINV)):
            a = np.full(size, base, U64)
            a[0] = 1
            tables[key] = np.cumprod(a, dtype=U64)
    return tables["p"][:n], tables["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that every bit is usable."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def space_table(lower: bool) -> np.ndarray:
    """Words are runs of bytes other than space and 0x09-0x0D; A-Z lowered on request."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255  # byte 0 is a word byte; 255 never occurs in UTF-8
    t[[9, 10, 11, 12, 13, 32]] = 0
    if lower:
        t[65:91] += 32
    return t


def letter_table() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lowered."""
    t = np.zeros(256, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        t[a:b] = np.arange(a, b)
    t[65:91] = np.arange(97, 123)
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b, o.astype(np.int64)


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of whole rows of about max_bytes."""
    data, o = buffers(col)
    lo, n = 0, len(o) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[o[lo]:o[hi]], o[lo:hi + 1] - o[lo]
        lo = hi
    released()


def released() -> None:
    """Gives freed memory back to the system: workers stay alive for the stages that follow."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only an allocator that keeps none needs no such call


class Words:
    """Words of a chunk: start and end byte, row, 64-bit hash, and first word of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        b = table[buf]
        inside = b != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(b))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)  # words of row r: bounds[r]..bounds[r+1]
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.bounds))
        self.prefix = prefix(b)
        self.hash = range_hash(self.prefix, self.start, self.end)


def prefix(b: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * p[:len(b)], out=c[1:])
    return c


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64))


def sequence_prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums over a sequence of 64-bit symbols, for range_hash()."""
    p, _ = _powers(len(h) + 1)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[:len(h)], out=c[1:])
    return c


def segment_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + count[i] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(start - (np.cumsum(count) - count), count)
    return base + np.arange(total)
