"""A compressed full-text index over integer symbols, and matching statistics.

What is kept of a text is the Burrows-Wheeler transform, in a wavelet tree stored level
by level (a wavelet matrix): one bit of every symbol a level, packed, with counts of ones
a word; how often each symbol occurs; and where blocks of suffixes that share their first
k - 1 symbols begin. Neither the text nor its suffix array is kept. Backward search
extends a pattern to the left in two rank queries a level. All queries work on arrays,
one lane for each pattern.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector with rank: packed words and ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        w = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols.astype(np.int32)
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            zeros = int(len(bit) - np.count_nonzero(bit))
            self.levels.append((level, Bits(bit), zeros))
            now = np.concatenate([now[~bit], now[bit]])
        # Where each symbol begins once all levels have parted it from the others.
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((c >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c stands in front of `at`."""
        return self._down(c, at) - self.start[c]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first `depth` symbols at least (ties in any order), by
    prefix doubling from as many symbols as fit 62 bits; then the ranks of all suffixes by
    their first `size` symbols, for the largest size of the doubling below depth, and size."""
    n = len(text)
    # 0 stands for what lies behind the end.
    symbols = text.astype(np.int64) + 1
    bits = int(symbols.max(initial=1)).bit_length()
    size = max(1, min(62 // bits, depth - 1))
    key = symbols.copy()
    for d in range(1, size):
        key <<= bits
        key[: max(n - d, 0)] |= symbols[d:]
    known, known_size = symbols, 1
    while True:
        order = np.argsort(key).astype(np.int32)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
        if size < depth:
            known, known_size = rank, size
        if size >= depth:
            return order, known, known_size
        key = rank * (n + 2)
        key[: max(n - size, 0)] += rank[size:]
        size *= 2


class FMIndex:
    """Index of segments of symbols (0 to sigma - 1), answering for windows of k symbols.

    Segments are joined with a separator that no query holds. Suffixes are sorted to k
    symbols at least, which is all that queries of up to k can tell apart."""

    def __init__(self, segments: np.ndarray, first: np.ndarray, k: int):
        n_seg = len(first) - 1
        self.k = k
        # Symbol 0 separates.
        text = np.zeros(len(segments) + n_seg, np.int32)
        text[np.arange(len(segments)) + np.repeat(np.arange(n_seg), np.diff(first))] = segments + 1
        self.size, self.sigma = len(text), int(text.max(initial=0)) + 1
        order, rank, length = suffix_order(text, k)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        # Two suffixes share k - 1 symbols if they share `length` from either end of these.
        new = np.ones(len(text), bool)
        same = rank[order[1:]] == rank[order[:-1]]
        if k - 1 > length:
            later = np.concatenate([rank, np.zeros(k, np.int64)])[order + (k - 1 - length)]
            same &= later[1:] == later[:-1]
        new[1:] = ~same if k > 1 else False
        self.new_block = Bits(new)
        self.blocks = np.append(np.flatnonzero(new), len(text)).astype(np.int32)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of c followed by what stands for [lo, hi)."""
        n = len(c)
        found = self.counts[:-1][np.concatenate([c, c])] + self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return found[:n], found[n:]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first k - 1 symbols of intervals of k."""
        block = self.new_block.ones(lo + 1) - 1
        return self.blocks[block].astype(np.int64), self.blocks[block + 1].astype(np.int64)

    def stream(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of documents, capped at k: for each position the interval of
        suffixes that start with the k symbols from there; empty where fewer than k match
        or are left. Lanes move from the right to the left, one document each. After
        k symbols the last is dropped (the interval of k - 1 is a block) before the next
        is added; a lane that matches nothing starts anew."""
        lo, hi = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        live = np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), side="right")
        end = first[1:][order]
        a, b, length = np.zeros(len(n), np.int64), np.full(len(n), self.size), np.zeros(len(n), np.int64)
        for t, m in enumerate(live):
            at = end[:m] - 1 - t
            c = symbols[at] + 1
            ok = c < self.sigma
            whole = ok.all()
            if not whole:
                c = np.where(ok, c, 0)
            x, y = self.extend(c, a[:m], b[:m])
            grown = y > x
            if not whole:
                grown &= ok
            length[:m] += grown
            if not grown.all():
                # Nothing matches to the left of what stood here: shrink to what does.
                miss = ok & ~grown
                if miss.any():
                    x[miss], y[miss], length[:m][miss] = self._restart(symbols, at[miss], end[:m][miss])
                dead = ~ok
                x[dead], y[dead], length[:m][dead] = 0, self.size, 0
            full = length[:m] >= self.k
            if full.all():
                lo[at], hi[at] = x, y
                x, y = self.shorten(x)
                length[:m] = self.k - 1
            elif full.any():
                lo[at[full]], hi[at[full]] = x[full], y[full]
                x[full], y[full] = self.shorten(x[full])
                length[:m][full] = self.k - 1
            a[:m], b[:m] = x, y
        return lo, hi

    def _restart(self, symbols: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match, under k symbols, that starts at `at`: found by trying the
        window's prefixes, longest first, each from its right end."""
        x, y, best = np.zeros(len(at), np.int64), np.full(len(at), self.size), np.zeros(len(at), np.int64)
        open_ = np.ones(len(at), bool)
        for size in range(self.k - 1, 0, -1):
            lanes = np.flatnonzero(open_ & (at + size <= end))
            if not len(lanes):
                continue
            lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.size)
            for d in range(size - 1, -1, -1):
                s = symbols[at[lanes] + d] + 1
                known = s < self.sigma
                lo, hi = self.extend(np.where(known, s, 0), lo, hi)
                hi = np.where(known, hi, lo)
            found = hi > lo
            x[lanes[found]], y[lanes[found]], best[lanes[found]] = lo[found], hi[found], size
            open_[lanes[found]] = False
        return x, y, best
