"""ProbMinHash signatures of weighted sets and the exact probability Jaccard similarity, by numpy."""

from __future__ import annotations

import numpy as np

from quillstack.llm.decontamination import words as text_words

SHINGLE, REGISTERS, ROWS = 5, 192, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, at most ``limit`` of them."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHashes()


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the text's 5-word shingles; a shorter text with words is one shingle."""
    found = text_words(text)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h, np.zeros(0)
    n = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - n + 1, np.uint64(n))
        for j in range(n):
            acc += mix(h[j : len(h) - n + 1 + j] + _POWERS[j]) * _POWERS[j]
        unique, counts = np.unique(mix(acc), return_counts=True)
    return unique, counts.astype(np.float64)


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Per register the element whose Poisson process (of rate its weight) arrives there first.

    Arrivals depend on the element and their number alone. An element is followed only as long as its next arrival
    is before the latest of all registers' first arrivals: no later one can change the result.
    """
    first, who = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    live, rate, time, k = elements, weights, np.zeros(len(elements)), 0
    with np.errstate(over="ignore"):
        while len(live):
            many = max(1, 2 * registers // len(live))  # arrivals of each element in this round
            no = np.arange(k, k + many, dtype=np.uint64)
            bits = mix(live[:, None] + (no + np.uint64(1)) * _STEP)
            gaps = -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            at = time[:, None] + np.cumsum(gaps, axis=1) / rate[:, None]
            where = mix(bits ^ _POWERS[0]) % np.uint64(registers)
            flat, slot, owner = at.ravel(), where.ravel().astype(np.int64), np.repeat(live, many)
            limit = first.max()
            if np.isinf(limit) and len(flat) > 16 * registers:  # the earliest usually fill all registers
                near = np.argpartition(flat, 16 * registers)[: 16 * registers]
                if len(np.unique(slot[near])) == registers:
                    flat, slot, owner = flat[near], slot[near], owner[near]
            else:
                near = np.flatnonzero(flat < limit)
                flat, slot, owner = flat[near], slot[near], owner[near]
            order = np.lexsort((owner, flat))[::-1]  # the last written, hence the earliest, stays
            best, name = np.full(registers, np.inf), np.zeros(registers, np.uint64)
            best[slot[order]] = flat[order]
            name[slot[order]] = owner[order]
            better = best < first
            first[better], who[better] = best[better], name[better]
            time = at[:, -1]
            go = time < first.max()
            live, rate, time, k = live[go], rate[go], time[go], k + many
    return who


def bands(who: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = who.reshape(-1, rows)
        acc = np.arange(len(parts), dtype=np.uint64) * _STEP
        for j in range(rows):
            acc = mix(acc * _POWERS[1] + parts[:, j])
    return acc.view(np.int64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    (a, wa), (b, wb) = x, y
    if not len(a) or not len(b):
        return 0.0
    shared, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    xs, ys = wa[ia], wb[ib]
    only_x, only_y = wa.sum() - xs.sum(), wb.sum() - ys.sum()
    ratio = ys / xs
    order = np.argsort(ratio, kind="stable")
    ratio, xs, ys = ratio[order], xs[order], ys[order]
    # sum over e of max(x_e, y_e / r): x where y_e / x_e <= r, y / r beyond
    upto = np.searchsorted(ratio, ratio, "right")
    below, above = np.concatenate([[0], np.cumsum(xs)])[upto], ys.sum() - np.concatenate([[0], np.cumsum(ys)])[upto]
    return float(np.sum(xs / (only_x + below + (only_y + above) / ratio)))
