"""Words of whole texts as numpy arrays: the shared tokenizer of the operators that compare words.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. Texts arrive as Arrow string
arrays and are looked at as the UTF-8 bytes that Arrow holds, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: bytes of text that are turned into arrays at once; about sixty times as much memory is used meanwhile
PIECE = (1 << 20) - 1

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE_CODE = np.array([_mixed(b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256)], np.uint64)
_BYTE_CODE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0  # white space does not change what stands between two words
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for positions below ``n``."""
    size = 1 << max(10, n.bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row in them; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), at


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about ``size`` that cover all rows and cut no word."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + size)
        if hi < end:
            row_start = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if row_start > lo:
                hi = row_start
            else:  # a row longer than a piece: go back, or else on, to a byte outside words
                back = np.flatnonzero(~IS_WORD[data[lo + 1 : hi]])
                if len(back):
                    hi = lo + 1 + int(back[-1])
                else:
                    row_end = int(offsets[np.searchsorted(offsets, lo, "right")])
                    while hi < row_end and IS_WORD[data[hi]]:
                        hi += 1
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    """Words of one piece. ``gaps[i]`` is the hash of what is not white space between word i and the next one."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    gaps: np.ndarray
    heads: np.ndarray | None


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, heads: tuple[int, ...] = ()) -> Words:
    """Of the words in ``data[lo:hi]``: 64-bit hash, row, first byte, end byte, gap, and hashes of their first bytes.

    ``heads`` names how many leading bytes to hash; words that are not longer get 0 there.
    """
    part = data[lo:hi]
    inside = IS_WORD[part]
    first_row, last_row = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
    edge = np.empty(len(part) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets[first_row + 1 : last_row + 1] - lo] = True  # a word ends with its row, whatever the next row begins with
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    up, down = _power_tables(len(part))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[part] * up[: len(part)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    gaps = np.zeros(len(starts), np.uint64)
    if len(starts):
        gaps[:-1] = mix((total[starts[1:]] - total[ends[:-1]]) * down[ends[:-1]])
    begun = None
    if heads:
        begun = np.zeros((len(heads), len(starts)), np.uint64)
        for k, n in enumerate(heads):
            long = np.flatnonzero(ends - starts > n)
            at = starts[long]
            begun[k, long] = mix((total[at + n] - total[at]) * down[at] + np.uint64(n))
    # rows by run lengths: how many words begin before each row boundary
    upto = np.searchsorted(starts, offsets[first_row + 1 : last_row + 1] - lo)
    rows = np.repeat(np.arange(first_row, last_row + 1), np.diff(np.r_[0, upto, len(starts)]))
    return Words(hashes, rows, starts + lo, ends + lo, gaps, begun)


def row_words(column: pa.Array, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of all words of a column, piece by piece; rows never go back.

    Where a row goes on from one piece to the next, its last ``overlap`` words come again, so that no window is lost.
    """
    data, offsets = string_buffers(column)
    hashes, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo, hi in pieces(data, offsets):
        w = words_of(data, offsets, lo, hi)
        if overlap and len(rows) and len(w.rows) and rows[-1] == w.rows[0]:
            tail = slice(max(len(rows) - overlap, int(np.searchsorted(rows, rows[-1]))), None)
            hashes, rows = np.r_[hashes[tail], w.hashes], np.r_[rows[tail], w.rows]
        else:
            hashes, rows = w.hashes, w.rows
        if len(rows):
            yield hashes, rows
