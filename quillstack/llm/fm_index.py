"""FM-index over integer symbols: suffix array by prefix doubling, wavelet-tree ranks, sampled suffix positions.

All queries are vectorised: a whole set of patterns of one length walks backwards together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a text whose last symbol is 0 and stands nowhere else, by prefix doubling.

    Only suffixes whose order is still open are sorted again, so long repeats cost rounds, not whole sorts.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    sorted_text = text[order]
    head = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks[order] = start
    width = 1
    # slots of order whose group has more than one member
    open_slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_slots):
        members = order[open_slots]
        group = ranks[members]
        after = members + width
        nxt = np.where(after < n, ranks[np.minimum(after, n - 1)], -1)
        by = np.lexsort((nxt, group))
        members, group, nxt = members[by], group[by], nxt[by]
        order[open_slots] = members
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        start = np.maximum.accumulate(np.where(head, open_slots, -1))
        ranks[members] = start
        single = head & np.append(head[1:], True)
        open_slots = open_slots[~single]
        width *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence: one bit level a code bit, kept as cumulative zero counts (a wavelet matrix)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros, self.before = [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            cum = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(1 - bit, out=cum[1:])
            self.before.append(cum)
            self.zeros.append(int(cum[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            cum, one = self.before[i], (symbol >> level) & 1 == 1
            zlo, zhi = cum[lo], cum[hi]
            lo = np.where(one, self.zeros[i] + lo - zlo, zlo)
            hi = np.where(one, self.zeros[i] + hi - zhi, zhi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for i in range(self.levels):
            cum = self.before[i]
            bit = 1 - (cum[at + 1] - cum[at])
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[i] + at - cum[at], cum[at])
        return out


class FMIndex:
    """symbols: integers of 1 to sigma - 1; a 0 is appended as the end."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        text = np.append(symbols, 0).astype(np.int64)
        sa = suffix_array(text)
        self.n, self.sigma = len(text), sigma
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # positions divisible by `sample`: which rows hold them, and the positions in row order
        held = sa % sample == 0
        self.held_before = np.concatenate([[0], np.cumsum(held)])
        self.positions = sa[held]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each row of the pattern matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.starts[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.starts[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows: LF steps to the next sampled one."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            open_ = open_[self.held_before[here + 1] == self.held_before[here]]
            here = at[open_]
            c = self.tree.access(here)
            at[open_] = self.starts[c] + self.tree.rank(c, here)
            steps[open_] += 1
        return self.positions[self.held_before[at]] + steps
