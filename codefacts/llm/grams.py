"""Indicator features of whole texts, hashed into a fixed number of buckets; what the two text classifiers look at."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from codefacts.llm import words as W

#: texts of at most this many bytes together are turned into features at once; a longer text is done piece by piece
SLICE = 1 << 20


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each."""
    _, offsets = W.string_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(to, rows)
        row = to


def indicators(column: pa.Array, bits: int, heads: Sequence[int] = (), pairs: bool = True, gaps: bool = True, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature that a row has, each once, sorted by row.

    Features: words, and on demand word pairs, beginnings of words (``heads`` bytes), what stands between words, and
    that a word stands two, three or four times in a row. Null and empty texts have none. ``wanted`` says for each
    bucket whether it matters; the others are left out early.
    """
    data, offsets = W.string_buffers(column)
    mask = np.uint64((1 << bits) - 1)
    found: list[np.ndarray] = []

    def add(rows: np.ndarray, values: np.ndarray, kind: int) -> None:
        buckets = W.mix(values + np.uint64(kind * 0x51ED270B)) & mask
        if wanted is not None:
            keep = wanted[buckets]
            rows, buckets = rows[keep], buckets[keep]
        found.append((rows.astype(np.uint64) << np.uint64(bits)) | buckets)

    before: tuple[int, np.ndarray] | None = None
    for lo, hi in W.pieces(data, offsets):
        w = W.words_of(data, offsets, lo, hi, tuple(heads))
        if not len(w.rows):
            continue
        add(w.rows, w.hashes, 1)
        for k in range(len(heads)):
            has = w.heads[k] != 0
            add(w.rows[has], w.heads[k][has], 2 + k)
        hashes, rows = w.hashes, w.rows
        if before is not None and before[0] == rows[0]:  # the row began in the piece before
            hashes, rows = np.r_[before[1], hashes], np.r_[np.full(len(before[1]), before[0]), rows]
        same_row = rows[1:] == rows[:-1]
        if pairs:
            add(rows[1:][same_row], (hashes[:-1] * np.uint64(3) ^ hashes[1:])[same_row], 20)
        if gaps:
            inner = w.rows[1:] == w.rows[:-1]
            add(w.rows[1:][inner], w.gaps[:-1][inner], 21)
            again = same_row & (hashes[1:] == hashes[:-1])
            for n in (2, 3, 4):
                run = again.copy() if n == 2 else run[1:] & again[: len(run) - 1]
                at = np.flatnonzero(run)
                add(rows[at], np.full(len(at), n, np.uint64), 22)
        before = (int(rows[-1]), hashes[max(len(hashes) - 3, int(np.searchsorted(rows, rows[-1]))) :])
        found = [np.unique(np.concatenate(found))]  # keeps memory to one piece and what is distinct so far
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = found[0]
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & mask).astype(np.int64)
