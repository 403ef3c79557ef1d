"""Run-length index of a set of strings: run-compressed Burrows-Wheeler transform, sampled at its runs, and matching statistics.

Rows are the suffixes of all strings in order; a string's end is less than any byte, ends of equal suffixes keep the order
of their strings. The transform is kept as runs of equal symbols. Where a run begins, the suffix one symbol longer is a
sample: its position, the position of the suffix in the row above (the end of the run before with that symbol) and the length
they have in common. Between two samples nothing is stored: as long as a row and the row above stay in one run, stepping one
symbol to the left moves both positions by one and lengthens the match by one. So the samples, as many as runs, give for any
position its match with the row above: copies of a passage add positions, but hardly any runs."""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits (byte + 1; 0 ends a string) that one word holds.
WORD, BITS = 7, 9


class RunIndex:
    """`text` holds the strings one after the other, `lengths` their bytes. Positions count one end symbol behind each string."""

    def __init__(self, text: bytes, lengths: np.ndarray) -> None:
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        n = int(self.ends[-1]) + 1 if len(lengths) else 0
        symbols = np.zeros(n + WORD, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        symbols[:n][inside] = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        self._left = np.repeat(self.ends, lengths + 1) - np.arange(n)
        words = self._words(symbols, n)
        rank = self._suffix_ranks(words, int(lengths.max(initial=0)) + 1)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self._runs(symbols, rank, order, words)

    def _words(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """The first seven symbols of each suffix; nothing of the next string."""
        words = np.zeros(n, np.int64)
        for j in range(WORD):
            words = (words << BITS) | np.where(self._left >= j, symbols[j:j + n], 0)
        return words

    def _suffix_ranks(self, words: np.ndarray, longest: int) -> np.ndarray:
        """Rows of the positions, by doubling; only suffixes that still tie are sorted again."""
        n = len(words)
        order = np.argsort(words)
        rank = np.empty(n, np.int64)
        tied = _classes(words[order], np.zeros(n, np.int64), np.arange(n), order, rank)
        width = WORD
        while len(tied) and width < longest:
            far = np.where(self._left[tied] >= width, rank[np.minimum(tied + width, n - 1)] + 1, 0)
            tied = _refine(tied, far, rank, n)
            width *= 2
        if len(tied):
            _refine(tied, tied, rank, n)
        return rank

    def _runs(self, symbols: np.ndarray, rank: np.ndarray, order: np.ndarray, words: np.ndarray) -> None:
        n = len(order)
        before = np.where(order > 0, symbols[order - 1], 0)
        begins = np.ones(n, bool)
        begins[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(begins)
        #: The transform: symbol and first row of each run.
        self.run_symbols, self.run_rows = before[heads], heads
        longer = order[heads[before[heads] > 0]] - 1
        self.samples = np.sort(np.concatenate([longer, self.ends]))
        rows = rank[self.samples]
        self.above = np.where(rows > 0, order[rows - 1], -1)
        self.common = self._common(words, self.samples, self.above)

    def _common(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common, ends not counted."""
        most = np.where(b >= 0, np.minimum(self._left[a], self._left[np.maximum(b, 0)]), 0)
        out, live, done = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            differ = words[a[live] + done] ^ words[b[live] + done]
            ended = differ != 0
            same = sum((differ[ended] >> BITS * j == 0).astype(np.int64) for j in range(WORD))
            out[live[ended]] = np.minimum(done + same, most[live[ended]])
            done += WORD
            live = live[~ended & (most[live] > done)]
        return out

    def match(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: per position, the position of the row above and the length of their match."""
        at = np.searchsorted(self.samples, positions)
        steps = self.samples[at] - positions
        return self.above[at] - steps, self.common[at] + steps

    def first_of_equals(self, positions: np.ndarray, length: int) -> np.ndarray:
        """Per position (ascending), the index of the first one whose string of `length` bytes is the same. Rows with equal
        strings stand together: chains of rows above are followed by pointer jumping."""
        above, common = self.match(positions)
        own = np.arange(len(positions))
        top = np.where(common >= length, np.searchsorted(positions, np.maximum(above, 0)), own)
        while not np.array_equal(top, nxt := top[top]):
            top = nxt
        first = np.empty(len(positions), np.int64)
        first[top[::-1]] = own[::-1]
        return first[top]


def _classes(keys: np.ndarray, base: np.ndarray, places: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Gives sorted suffixes the row of the first of their class; returns those that share one."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    rank[order] = base + np.repeat(places[first], size)
    return order[np.repeat(size > 1, size)]


def _refine(tied: np.ndarray, far: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Sorts suffixes of equal rank by `far`."""
    old = rank[tied]
    keys = old * (n + 1) + far
    by = np.argsort(keys)
    old, keys, tied = old[by], keys[by], tied[by]
    start = np.ones(len(old), bool)
    start[1:] = old[1:] != old[:-1]
    first = np.flatnonzero(start)
    place = np.arange(len(old)) - np.repeat(first, np.diff(np.append(first, len(old))))
    return _classes(keys, old, place, tied, rank)
