"""Suffixes of a block of bytes: cover samples, fingerprints of what they start with, classes of equal ones.

A difference cover of ``PERIOD`` is a set of residues such that any two positions have a common distance to positions of
the set, under the period. So if two strings of ``LENGTH`` bytes are equal, two sampled suffixes at the same place in both
start with the same ``HEAD`` = LENGTH + 1 - PERIOD bytes: a suffix near no repeated sample ties with none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PERIOD, LENGTH = 57, 100
HEAD = LENGTH + 1 - PERIOD
#: A perfect difference set: every residue is the difference of two of these exactly once (fixed values).
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
MASK = (1 << 64) - 1


@lru_cache(4)
def _weights(which: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every byte value, the powers of an odd base and their inverses, all modulo 2**64."""
    draw = np.random.default_rng([which, 100])
    values = draw.integers(0, MASK, 256, np.uint64, endpoint=True)
    base = int(draw.integers(0, MASK, dtype=np.uint64)) | 5

    def powers(b: int) -> np.ndarray:
        out = np.full(length, b & MASK, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return values, powers(base), powers(pow(base, -1, 1 << 64))


class Prints:
    """Fingerprints of any part of a block of bytes in constant time each: polynomials modulo 2**64 over random byte values."""

    def __init__(self, body: np.ndarray, which: int):
        room = 1 << max(16, int(len(body)).bit_length())
        values, powers, self.inverse = _weights(which, room)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(values[body] * powers[: len(body)], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def bytes_left(ends: np.ndarray) -> np.ndarray:
    """Per byte the bytes from it to its slice's end."""
    sizes = np.diff(ends, prepend=0)
    return np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)


def sampled(left: np.ndarray) -> np.ndarray:
    """The positions of the cover sample that have a whole head before their slice ends."""
    at = (np.arange(0, len(left), PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < len(left)]
    return at[left[at] >= HEAD]


def near_repeats(left: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """The positions of whole strings of LENGTH bytes that have a repeated sample in their first PERIOD bytes."""
    seen = np.zeros(len(left) + 1, np.int32)
    seen[repeated + 1] = 1
    np.cumsum(seen, out=seen)
    at = np.flatnonzero(left >= LENGTH)
    return at[seen[at + PERIOD] > seen[at]]


def classes(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs side by side: an order by ``first``, and where in it a new pair begins. Within a class the order is that given."""
    n = len(first)
    bits = np.uint64(max(1, n - 1).bit_length())
    here = np.arange(n, dtype=np.uint64)
    both = np.sort((first >> bits << bits) | here)
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(n, bool)

    def starts(order: np.ndarray) -> None:
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])

    starts(order)
    head = both >> bits
    if (new[1:] & (head[1:] == head[:-1])).any():  # different pairs that agree in what was sorted by
        order = np.lexsort((here, second, first))
        starts(order)
    return order, new


def split(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of the runs of an ascending array."""
    if not len(parts):
        return []
    cut = np.flatnonzero(np.diff(parts)) + 1
    starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(parts)]
    return [(int(parts[s]), s, e) for s, e in zip(starts, ends, strict=True)]


def union(starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(n, 2) maximal spans covered by strings of the length at the ascending starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([np.concatenate([starts[:1], starts[cut + 1]]), np.concatenate([starts[cut], starts[-1:]]) + length], 1)
