"""FM-index over integer sequences: suffix order, Burrows-Wheeler symbols in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of text in order, by prefix doubling; only ties are ordered again."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(text, kind="stable")
    key = text[order]
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    h = 1
    while h < n:
        sizes = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.repeat(sizes > 1, sizes)  # places in the order that share their rank
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        pos = order[at]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        pair = rank[pos] * np.int64(n + 1) + after
        by = np.argsort(pair, kind="stable")
        pos, pair = pos[by], pair[by]
        order[at] = pos
        head[at[1:]] |= pair[1:] != pair[:-1]
        starts = np.flatnonzero(head)
        rank[order[at]] = starts[np.cumsum(head)[at] - 1]
        h *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels, self.zeros = len(symbols), [], []
        self.depth = max(1, int(top).bit_length())
        for k in reversed(range(self.depth)):
            bit = (symbols >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = bits.ones(i)
            i = np.where(c >> (self.depth - 1 - level) & 1, zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i, for arrays of both."""
        return self._walk(c, i) - self.first[c]


class FMIndex:
    """Index of runs of symbols 1..top, which no match crosses: `runs` are laid end to end, with a separator before each and at the end."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, top: int):
        """symbols: the runs, one after another; starts: where each begins."""
        runs = len(starts)
        self.n = len(symbols) + runs + 1
        at = np.arange(len(symbols)) + np.searchsorted(starts, np.arange(len(symbols)), side="right")  # place in the text with separators
        text = np.zeros(self.n, np.int64)
        text[at] = symbols
        #: Separators differ from each other, so that the order never looks across one.
        unique = text + runs
        unique[np.append(starts + np.arange(runs), self.n - 1)] = np.arange(runs + 1)
        self.order = suffix_order(unique)
        prior = np.where(self.order > 0, text[self.order - 1], 0)
        self.bwt = prior
        self.wavelet = WaveletMatrix(prior, top)
        counts = np.bincount(text, minlength=top + 1)
        self.start = np.concatenate([[0], np.cumsum(counts)])[: top + 1]
        #: A row's position is kept if it is a multiple of SAMPLE or a run's first, so that no walk meets a separator.
        keep = (self.order % SAMPLE == 0) | (prior == 0)
        self.kept, self.position = Bits(keep), self.order[keep]
        self.is_kept = keep
        self.to_symbol = np.full(self.n, -1, np.int64)
        self.to_symbol[at] = np.arange(len(symbols))
        del self.order

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns, one a row: numbers of those that occur, and their first and last + 1 rows."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[which, j].astype(np.int64)
            lo, hi = self.start[c] + self.wavelet.rank(c, lo), self.start[c] + self.wavelet.rank(c, hi)
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in `symbols` of the suffixes at rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.is_kept[rows[left]]
            out[left[done]] = self.position[self.kept.ones(rows[left[done]])] + steps[left[done]]
            left = left[~done]
            c = self.bwt[rows[left]]
            rows[left] = self.start[c] + self.wavelet.rank(c, rows[left])
            steps[left] += 1
        return self.to_symbol[out]
