"""An FM-index over a sequence of small integers, for counting and locating many patterns at once.

The suffix array comes from prefix doubling, the Burrows-Wheeler transform from it, and ranks
from a wavelet matrix: one bit vector with running counts for each bit of the alphabet. Every
operation takes arrays, so that a step of the search moves all patterns at once.

Symbol 0 separates runs and occurs in no pattern. Separators sort by their place, so suffixes
never tie and comparing stops at the end of a run.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every SAMPLE-th place of the text keeps its suffix position


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order. The last symbol must be 0."""
    n = len(text)
    zero = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zero)
    rank[zero] = np.arange(len(zero))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        after = np.full(n, 0, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (seq >> bit & 1).astype(bool)
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(seq) - int(count[-1])))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        at, low = i, np.zeros_like(i)
        for bit, count, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + count[at], at - count[at])
            low = np.where(one, zeros + count[low], low - count[low])
        return at - low


class FmIndex:
    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        """text: symbols below alphabet, 0 last."""
        n = self.n = len(text)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, max(1, (alphabet - 1).bit_length()))
        kept = (order % SAMPLE == 0) | (self.bwt == 0)  # a walk back never has to cross a separator
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each pattern (right-aligned rows)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.before[symbol] + both[: len(live)]
            high[live] = self.before[symbol] + both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one."""
        out, walked = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.samples[self.kept_before[at[done]]] + walked
            todo, at = todo[~done], at[~done]
            symbol = self.bwt[at]
            at = self.before[symbol] + self.wavelet.rank(symbol, at)
            walked += 1
        return out
