"""ProbMinHash signatures of weighted word shingles, for whole batches of texts at once.

Every distinct shingle of a text is a Poisson process whose rate is its weight, which the caller gives. An arrival
goes to a random register, and a register keeps the shingle that arrived first. Two texts agree in a register with the
probability Jaccard similarity of their weights. A shingle's process ends as soon as its next arrival is later than what
every register holds, so nearly all shingles are done after one or two arrivals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from codefacts.llm import words as W

#: words of a shingle; a text of fewer words is one shingle
SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of each text, sorted by row."""
    found: list[np.ndarray] = []
    hashes_found: list[np.ndarray] = []
    for hashes, rows in W.row_words(texts, SHINGLE - 1):
        n = len(hashes)
        if n >= SHINGLE:
            run = hashes[: n - SHINGLE + 1].copy()
            for j in range(1, SHINGLE):
                run = W.mix(run + np.uint64(j)) ^ hashes[j : n - SHINGLE + 1 + j]
            whole = rows[: n - SHINGLE + 1] == rows[SHINGLE - 1 :]
            found.append(rows[: n - SHINGLE + 1][whole])
            hashes_found.append(W.mix(run[whole]))
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        length = np.diff(np.r_[first, n])
        for at, size in zip(first[length < SHINGLE].tolist(), length[length < SHINGLE].tolist(), strict=True):
            value = np.full(1, size, np.uint64)  # texts of less than five words
            for k in range(at, at + size):
                value = W.mix(value + hashes[k : k + 1] * np.uint64(31))
            found.append(rows[at : at + 1])
            hashes_found.append(value)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows, values = np.concatenate(found), np.concatenate(hashes_found)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
    return rows[first], values[first], np.diff(np.r_[first, len(rows)])


def signatures(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each text, and which texts have any shingle."""
    held = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(values))
    row, value, weight = rows, values, weights.astype(np.float64)
    step = 0
    while len(row):
        step += 1
        draw = W.mix(value + np.full(1, _GOLDEN) * np.uint64(step))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / 2.0**53) / weight
        slot = row * registers + (W.mix(draw) % np.uint64(registers)).astype(np.int64)
        better = time < held[slot]
        np.minimum.at(held, slot[better], time[better])
        won = better & (held[slot] == time)
        owner[slot[won]] = value[won]
        latest = held.reshape(texts, registers).max(axis=1)
        on = time < latest[row]
        row, value, weight, time = row[on], value[on], weight[on], time[on]
    has = np.zeros(texts, bool)
    has[rows] = True
    return owner.reshape(texts, registers), has


def band_keys(owner: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of registers; keys of different bands differ."""
    per = owner.shape[1] // bands
    cut = owner[:, : per * bands].reshape(len(owner), bands, per)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(owner), bands)).copy()
    for k in range(per):
        key = W.mix(key + np.uint64(k + 1)) ^ cut[:, :, k]
    return W.mix(key).view(np.int64)
