"""Vectorised word splitting and hashing over Arrow string columns.

Tasks see Arrow batches.  A batch is cut into slices of a quarter of a
megabyte of UTF-8, so the working arrays stay in the cache whatever the batch
size (one longer text is a slice of its own).  Word and window hashes are 64-bit polynomial
prefix hashes: one cumulative sum per slice gives the hash of every word, and
a second one over the words gives the hash of every window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_WBASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Slice(NamedTuple):
    """Rows ``lo:hi`` of a batch: their bytes and ``hi - lo + 1`` offsets into them."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray


class Words(NamedTuple):
    """Word starts and ends (bytes, end exclusive), the slice row of each word, and words per row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray


def byte_set(ranges: str) -> np.ndarray:
    """Truth table over bytes of an inclusive list of ranges such as ``"09-0D 20-20"`` (hex)."""
    table = np.zeros(256, dtype=bool)
    for part in ranges.split():
        a, b = (int(x, 16) for x in part.split("-"))
        table[a : b + 1] = True
    return table


NOT_SPACE = ~byte_set("09-0D 20-20")
WORD_CHARS = byte_set("30-39 41-5A 61-7A 80-FF")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; null counts as empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    buf, off = strings(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield Slice(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def split(s: Slice, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes for which ``inside`` is true, none across rows."""
    rows = len(s.off) - 1
    if not len(s.buf):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(rows, np.int64))
    mask = inside[s.buf]
    edge = np.empty(len(mask) + 1, dtype=bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = True
    edge[s.off] = True  # row borders cut runs
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = mask[start]
    start, end = start[keep], end[keep]
    row = np.searchsorted(s.off, start, side="right") - 1
    return Words(start, end, row, np.bincount(row, minlength=rows))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (at least)."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 19, 1 << (n - 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 1 << 20:  # tables for a rare longer text are not kept
            _POW[base] = have
    return have


def word_hashes(buf: np.ndarray, w: Words) -> np.ndarray:
    up, down = _powers(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def rolling(h: np.ndarray, k: int, base: int = _WBASE) -> np.ndarray:
    """Hash of every ``k`` consecutive words, whatever rows they are in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + U64(k))


def window_starts(row: np.ndarray, k: int) -> np.ndarray:
    """Word numbers at which ``k`` words of one row start."""
    n = len(row) - k + 1
    return np.flatnonzero(row[:n] == row[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word number in the slice) and hash of every window of ``k`` words inside one row."""
    at = window_starts(row, k)
    return at, rolling(h, k)[at]


def first_of_row(count: np.ndarray) -> np.ndarray:
    """Number in the slice of each row's first word."""
    first = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    return first


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums modulo 2**64 of uint64 values by (non-decreasing) row."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(row, np.arange(rows + 1))
    return total[edge[1:]] - total[edge[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)
