"""Vectorised word splitting and hashing over the bytes of a whole Arrow text column.

A word is a maximal run of bytes other than space and TAB..CR; A-Z are lowered, nothing else is. The functions work on
the column's own byte buffer, so a batch costs a few passes of numpy over its bytes, whatever the number of rows.
Hashes are 64 bit: within a document, or between the two documents of a pair, an accidental equality has a chance of
about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that one numpy pass handles; a longer document is handled alone, whole.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK) + 1, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of consecutive rows of up to ``size`` bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, end, off[row : end + 1] - off[row], data[off[row] : off[end]]
        row = end


def spans(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more entry than rows)."""
    inside = ~GAP[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cuts = off[off < len(data)]
    first = before[:-1].copy()
    first[cuts] = False
    starts = np.flatnonzero(inside & ~first)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    last = after[1:].copy()
    last[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lowered word, equal wherever the word stands."""
    n = len(data) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * _power(_BASE, n)[:-1], dtype=np.uint64, out=total[1:])
    value = (total[ends] - total[starts]) * _power(_BACK, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each ``size`` consecutive words; element i belongs to the words from i on."""
    out = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k])
    return out


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every row; a text of fewer words is one shingle, without words none."""
    for row, end, off, data in chunks(column):
        starts, ends, firsts = spans(off, data)
        words = word_hashes(data, starts, ends)
        hashes = shingle_hashes(words, size)
        for i in range(end - row):
            lo, hi = firsts[i], firsts[i + 1]
            if hi - lo >= size:
                yield row + i, distinct(hashes[lo : hi - size + 1])
            elif hi > lo:
                short = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    short = mix(short * np.uint64(0x2545F4914F6CDD1D) + words[k : k + 1])
                yield row + i, short
            else:
                yield row + i, np.zeros(0, np.uint64)
