"""Words and word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` after folding A-Z.  Its hash is a polynomial over a random 64-bit
value of each byte, taken from running sums, so a batch costs a handful of array operations however
its words are cut; a shingle hashes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets from 0; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, off - off[0]


def fold(flat: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _FOLD[flat]


def spans(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) byte of every word of the texts that ``off`` cuts ``flat`` into."""
    n = len(flat)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[flat]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[off[:-1][off[:-1] < n]] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    return np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1


def hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every stretch of bytes, from one running sum."""
    n = len(flat)
    up, down = _power(n)
    run = np.empty(n + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[flat] * up[:n], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)) if len(start) else np.empty(0, np.uint64)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, n + 1 word offsets of the texts, start and end byte of each word)."""
    flat, off = buffers(column)
    flat = fold(flat)
    start, end = spans(flat, off)
    return hashes(flat, start, end), np.searchsorted(start, off).astype(np.int64), start, end


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, n + 1 offsets)."""
    h, off, _, _ = words(column)
    count = np.diff(off)
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, dtype=np.uint64)
    for j in range(width):
        s += h[j : j + m] * _PLACE[j]
    s = mix(s)
    sets = []
    for a, b, n in zip(off[:-1].tolist(), off[1:].tolist(), count.tolist()):
        if n >= width:
            sets.append(np.unique(s[a : b - width + 1]))
        elif n:
            short = (h[a:b] * _PLACE[:n]).sum(keepdims=True)
            sets.append(mix(short + np.uint64(n)))
        else:
            sets.append(np.empty(0, np.uint64))
    ends = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in sets], out=ends[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), ends


def signature(flat: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text and one column per seed (odd 64-bit); empty texts get the maximum."""
    n = len(off) - 1
    out = np.full((n, len(seeds)), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        at = off[:-1][full]
        base = flat ^ (flat >> np.uint64(32))
        for j, seed in enumerate(seeds):
            out[full, j] = np.minimum.reduceat(base * seed, at)
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    rng = np.random.default_rng(salt)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(flat: np.ndarray, off: np.ndarray, n: int, salt: int) -> np.ndarray:
    """As ``signature`` with ``n`` values of 16 bits, each a hash of the least of 32 bits; empty texts get zeros."""
    odd = np.random.default_rng(salt).integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(off) - 1, n), dtype=np.uint16)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        at = off[:-1][full]
        halves = (flat ^ (flat >> np.uint64(31))).astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
        for j in range(n):
            least = np.minimum.reduceat(halves[j % 2] * odd[j], at)
            out[full, j] = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out
