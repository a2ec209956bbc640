"""Simple-8b word-aligned integer coding with escapes, encoded and decoded by numpy over whole blocks.

A 64-bit word holds a selector in its top four bits and 60 bits of payload: COUNTS[s] codes of WIDTHS[s] bits each.
A value is stored as itself plus one; code 0 marks an escape, whose value stands in the block's list of escapes.
"""

from __future__ import annotations

import struct

import numpy as np

# The selectors, densest first.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIII")  # magic, values, words, escapes
_COUNT = np.array(COUNTS, np.int64)


def encode(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values -> one block."""
    n = len(values)
    code = values.astype(np.uint64) + 1
    far = code >> 20 != 0
    escapes = values[far].astype("<u4")
    code[far] = 0
    # choice[i]: the densest selector whose codes from i on all fit its width; the tail is padded with zeros
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    at = np.arange(n)
    for s in range(len(COUNTS) - 2, -1, -1):
        too_wide = np.where(code >> WIDTHS[s] != 0, at, n + COUNTS[0])
        reach = np.minimum.accumulate(too_wide[::-1])[::-1]
        choice[reach - at >= COUNTS[s]] = s
    step, starts, i = _COUNT[choice].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts, np.int64)
    chosen = choice[first] if n else np.zeros(0, np.int8)
    padded = np.concatenate([code, np.zeros(COUNTS[0], np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            shifted = padded[first[rows][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(width))
            words[rows] |= np.bitwise_or.reduce(shifted, axis=1)
    return _HEAD.pack(MAGIC, n, len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.tobytes()


def decode(block: bytes) -> np.ndarray:
    """One block -> its values as unsigned 32-bit integers."""
    magic, n, n_words, n_escapes = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    words = np.frombuffer(block, "<u8", n_words, _HEAD.size)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNT[chosen])
    first = ends - _COUNT[chosen]
    code = np.zeros(int(ends[-1]) if n_words else 0, np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            code[first[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)
    code = code[:n]
    out = (code - np.uint64(1)).astype(np.uint32)
    out[code == 0] = np.frombuffer(block, "<u4", n_escapes, _HEAD.size + 8 * n_words)
    return out
