"""A full-text index over numbered words: suffix array, wavelet matrix of the last column, sampled positions."""

from __future__ import annotations

import numpy as np

#: every so many positions of the text one is kept
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class FMIndex:
    """Index over ``text``, an array of numbers from 1 to ``top``. A closing 0 is added."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.n, self.bits = len(text), max(1, int(top).bit_length())
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = last
        for bit in range(self.bits - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(int(len(b) - b.sum()))
            level = np.concatenate([level[b == 0], level[b == 1]])
        sampled = order % SAMPLE == 0
        self.sampled, self.slot = sampled, np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` of the last column."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            at_lo, at_hi = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + at_lo, lo - at_lo), np.where(one, zeros + at_hi, hi - at_hi)
        return hi - lo

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one word earlier."""
        symbol, at, start = np.zeros_like(row), row.copy(), np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at] == 1
            symbol = symbol * 2 + one
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return self.before[symbol] + at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length, a row each: first and end row of their suffixes."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            lo[alive] = self.before[symbol] + self.rank(symbol, lo[alive])
            hi[alive] = self.before[symbol] + self.rank(symbol, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes: walk back to a sampled one."""
        out, at, walked = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.sampled[at[open_]]
            done = open_[found]
            out[done] = self.positions[self.slot[at[done]]] + walked[done]
            open_ = open_[~found]
            at[open_] = self.back(at[open_])
            walked[open_] += 1
        return out
