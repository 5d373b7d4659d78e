"""A hierarchical Pitman-Yor language model over three levels of restaurants.

* the root restaurant serves words, over a uniform base of 1 / (V + 1);
* a restaurant for each previous word shares the root as parent;
* a restaurant for each pair of previous words shares that of the previous word.

A training token is a customer of a third-level restaurant; a table there sends one customer to the
parent.  Customers of a word in a restaurant are seated by the Chinese restaurant process and then
reseated one at a time by Gibbs sampling.  Words of more than ``EXACT`` customers in a restaurant are
reseated together, a blocked Gibbs step: given all else their tables t have the probability
base^t S(c, t), S the generalised Stirling numbers of the discount, from which t is drawn exactly up
to ``STIRLING`` customers, and beyond it from the limit for many customers, 1 + Poisson(base / d).
The first ``BURN_IN`` seatings are left out; the score averages the predictive probabilities of the
``SAMPLES`` that follow.

Distribution.  The text is read once and becomes chunks of numbered words.

1. Every chunk tells groups of words its distinct words; a group sums them up and answers with their
   ids (small for frequent words) and counts.
2. A chunk reduces its tokens to types (word, previous word, the one before) with counts, and sends
   each type to the bucket of its previous word, so a passage repeated within a chunk travels once.
   The restaurants of a previous word and of its pairs are whole in a bucket.
3. In a seating every bucket draws the tables of its restaurants and tells the groups of words the
   customers of the root; a group seats the root for its words and answers.
4. Buckets answer the chunks with the probabilities of their types, in the order they came.

Previous words of more than ``HOT`` tokens are dealt over one section for every ``HOT`` tokens, by the
word before; a pair of more than ``HOT`` tokens is dealt by word.  The customers of such a previous word
are seated by word, with the root.  Only the totals of these restaurants and of the root are known to
all; there is at most one of each for every ``HOT`` tokens.  A task holds one chunk, one bucket or one
group of words, and a message at least one word or type, so nothing grows faster than the input.

Defined cases: a null, empty or blank text is its end token; rows that share an id are scored each;
a null id is in the training fold; without training rows every word is unknown, N and V are 0;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import shingles, tokens

BURN_IN, SAMPLES = 1, 2
EXACT, STIRLING = 12, 512
STRENGTH = 1.0
BUCKET_TOKENS = 700_000
#: Tokens from which a previous word, or a pair of them, is divided.
HOT = 200_000
CHUNK_TOKENS, CHUNK_DOCS = 600_000, 60_000
#: Bytes of input that a task reads at least, and rows that pass between Spark and Python at a time.
TASK_BYTES, BATCH_ROWS = 8 << 20, 64
#: Bytes of input to a group of words.
GROUP_BYTES = 8 << 20
_END = np.uint64(0x1F83D9ABFB41BD6B)
_START = np.uint64(0x5BE0CD19137E2179)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pack(*parts) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _thin(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 as byte planes of the least width, which compress well."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), kind.itemsize).T)


def _wide(planes: np.ndarray, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(kind)


def _press(*xs: np.ndarray) -> bytes:
    """Whole numbers as one small message: how many arrays, the width and length of each, their byte planes."""
    import zstandard

    thin = [_thin(x) for x in xs]
    head = b"".join(struct.pack("<BI", *x.shape) for x in thin)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(b"".join((bytes([len(xs)]), head, *(x.tobytes() for x in thin))))


def _planes(message: bytes) -> list[np.ndarray]:
    """The byte planes of ``_press``, for ``_wide``."""
    import zstandard

    flat = zstandard.ZstdDecompressor().decompress(message)
    at, out = 1 + 5 * flat[0], []
    for i in range(flat[0]):
        width, n = struct.unpack_from("<BI", flat, 1 + 5 * i)
        out.append(np.frombuffer(flat, np.uint8, width * n, at).reshape(width, n))
        at += width * n
    return out


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, tokens of each text); texts end with an end token."""
    h, off, _, _ = shingles.words(column)
    count = np.diff(off) + 1
    ends = np.cumsum(count) - 1
    w = np.empty(int(count.sum()), dtype=np.uint64)
    inner = np.ones(len(w), dtype=bool)
    inner[ends] = False
    w[inner], w[ends] = h, _END
    return w, count


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(k, train, word hashes, tokens of each text) of about ``most`` tokens at a time."""
    held: list = []
    size = docs = 0

    def join() -> tuple:
        return [k for x in held for k in x[0]], *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))

    for batch in tokens.slices(batches, "t", 1 << 20):
        if held and (size > most or docs + batch.num_rows > CHUNK_DOCS):
            yield join()
            held, size, docs = [], 0, 0
        held.append((batch.column("k").to_pylist(), batch.column("train").to_numpy(zero_copy_only=False).astype(bool), *token_stream(batch.column("t"))))
        size += len(held[-1][2])
        docs += batch.num_rows
    if held:
        yield join()


def _found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted array, or -1."""
    if not len(among):
        return np.full(len(keys), -1, dtype=np.int64)
    near = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[near] == keys, near, -1)


def _pair(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return shingles.mix(v.astype(np.uint64) * _STEP + shingles.mix(u.astype(np.uint64)))


def _deal(mixed: np.ndarray, ways: int) -> np.ndarray:
    """0 to ``ways`` - 1 by the top bits of a hash, in the order of the hashes."""
    return ((mixed >> np.uint64(34)).astype(np.int64) * ways) >> 30


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where any of the keys, which are sorted together, differs from the row before."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def _order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Sorting positions by several keys, each with its number of values, the first foremost."""
    bits = [max(1, int(n - 1).bit_length()) for _, n in keys]
    if sum(bits) > 64:
        return np.lexsort([k for k, _ in reversed(keys)])
    one = np.zeros(len(keys[0][0]), dtype=np.uint64)
    for (k, _), b in zip(keys, bits):
        one = (one << np.uint64(b)) | k.astype(np.uint64)
    return np.argsort(one)


@dataclass
class Hot:
    """Ids of the previous words, and keys of the pairs, that are divided, in ascending order; and the tokens of a section."""

    words: np.ndarray
    pairs: np.ndarray
    most: int

    def size(self) -> int:
        return 2 * len(self.words) + 2 * len(self.pairs) + 8

    def at(self, what: str) -> int:
        """Where in a vector of totals customers and tables of hot words and pairs, those of the root, and the numbers of
        types of one and two customers begin."""
        n, m = len(self.words), len(self.pairs)
        return {"c1": 0, "t1": n, "c2": 2 * n, "t2": 2 * n + m, "root": 2 * n + 2 * m, "ones": 2 * n + 2 * m + 2}[what]


@dataclass
class Chunk:
    """The tokens of a chunk as codes into its distinct words, which have ids and counts."""

    code: np.ndarray
    count: np.ndarray
    start: int
    ids: np.ndarray
    n: np.ndarray

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the previous word and of the one before it."""
        first = np.cumsum(self.count) - self.count
        v = np.empty_like(self.code)
        v[1:] = self.code[:-1]
        v[first] = self.start
        u = np.empty_like(self.code)
        u[1:] = v[:-1]
        u[first] = self.start
        return v, u

    def hot_pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words that are both frequent enough to be a hot pair, and their tokens."""
        v, u = self.before()
        often = self.n > most
        both = np.flatnonzero(often[v] & often[u])
        return np.unique(_pair(self.ids[v[both]], self.ids[u[both]]), return_counts=True)

    def arrange(self, hot: Hot, buckets: int) -> tuple[np.ndarray, ...]:
        """(tokens in the order of their types, where types begin in it, and of each type its bucket and the ids of
        previous word, the one before and word).  Types are in the order of these four."""
        v, u = self.before()
        m = len(self.ids)
        rank = np.empty(m, dtype=np.int32)
        rank[np.argsort(self.ids)] = np.arange(m, dtype=np.int32)
        mixed = shingles.mix(self.ids.astype(np.uint64))
        # Previous words with their bucket; a divided one has an entry for each of its buckets.
        bucket, vid, entry = _deal(mixed, buckets), self.ids, v.copy()
        often = np.flatnonzero((self.n > hot.most)[v])
        if len(often):
            hv, hu = v[often], u[often]
            divided = _found(_pair(self.ids[hv], self.ids[hu]), hot.pairs) >= 0
            by = np.where(divided, mixed[self.code[often]], mixed[hu])
            section = (by >> np.uint64(20)) % (-(-self.n[hv] // hot.most)).astype(np.uint64)
            there = _deal(shingles.mix(mixed[hv] + (section + np.uint64(1)) * _STEP), buckets)
            combo, at = np.unique(there * m + hv, return_inverse=True)
            entry[often] = m + at
            bucket, vid = np.concatenate((bucket, combo // m)), np.concatenate((vid, self.ids[combo % m]))
        place = np.empty(len(vid), dtype=np.int32)
        place[np.lexsort((vid, bucket))] = np.arange(len(vid), dtype=np.int32)
        x, y, z = place[entry], rank[u], rank[self.code]
        order = _order((x, len(vid)), (y, m), (z, m)).astype(np.int32)
        new = _starts(x[order], y[order], z[order])
        del x, y, z
        first = np.flatnonzero(new)
        one = order[first]
        return order, first, bucket[entry[one]], vid[entry[one]], self.ids[u[one]], self.ids[self.code[one]]


def blocks(chunk: Chunk, train: np.ndarray, hot: Hot, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its types): previous words with their numbers of types, then words before, words and counts."""
    if not len(chunk.code):
        return
    order, first, bucket, v, u, w = chunk.arrange(hot, buckets)
    c = np.add.reduceat(np.repeat(train, chunk.count)[order].astype(np.int64), first)
    cuts = np.append(np.flatnonzero(_starts(bucket)), len(bucket))
    new = _starts(bucket, v)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = np.flatnonzero(new[a:b])
        yield int(bucket[a]), _press(v[a:b][at], np.diff(np.append(at, b - a)), u[a:b], w[a:b], c[a:b])


@dataclass
class Types:
    """A bucket: its words, its groups (previous word, word), and its types, each with its group, its pair
    of previous words and its training count; previous words and pairs are numbered within the bucket."""

    word: np.ndarray
    heavy: np.ndarray  # of each previous word its index among the hot ones, or -1
    pairs: np.ndarray  # as ``heavy``, of each pair of previous words
    gw: np.ndarray
    gc: np.ndarray
    g: np.ndarray
    c2: np.ndarray
    c: np.ndarray
    hot: np.ndarray = field(init=False)  # groups of hot previous words
    some: np.ndarray = field(init=False)  # types of several customers

    def __post_init__(self) -> None:
        self.hot = np.flatnonzero(self.heavy[self.gc] >= 0)
        self.some = np.flatnonzero(self.c > 1)

    def customers(self, t2: np.ndarray) -> np.ndarray:
        """Those of the groups, which are the tables of their types."""
        return np.bincount(self.g, weights=t2, minlength=len(self.gw)).astype(np.int64)


def merge(blobs: list[bytes], hot: Hot) -> tuple[bytes, bytes]:
    """A bucket's types from the blocks of all chunks, and where the types of each block are among them."""
    got = [_planes(x) for x in blobs]
    before, at = np.unique(np.concatenate([_wide(x[0]) for x in got]), return_inverse=True)
    v = np.repeat(at.astype(np.int32), np.concatenate([_wide(x[1], np.int32) for x in got]))
    word, w = np.unique(np.concatenate([_wide(x[3]) for x in got]), return_inverse=True)
    w = w.astype(np.int32)
    u = np.concatenate([_wide(x[2]) for x in got])
    c = np.concatenate([_wide(x[4], np.int32) for x in got])
    sizes = np.array([x[2].shape[1] for x in got])
    del got, at
    order = _order((v, len(before)), (u, int(u.max()) + 1), (w, len(word))).astype(np.int32)
    v, u, w, c = v[order], u[order], w[order], c[order]
    new = _starts(v, u, w)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    c = np.add.reduceat(c, first, dtype=np.int64)
    v, u, w = v[first], u[first], w[first]
    del order, new
    # Types of a block are in the order of all types.
    ends = np.cumsum(sizes)
    step = np.diff(place, prepend=np.int32(0))
    step[ends - sizes] = place[ends - sizes]
    del place
    pair = _starts(v, u)
    group, g = np.unique(v.astype(np.int64) * len(word) + w, return_inverse=True)
    gc = group // len(word)
    heavy = _found(before, hot.words)
    own = np.flatnonzero(pair)
    pairs = np.full(len(own), -1, dtype=np.int64)
    often = np.flatnonzero(heavy[v[own]] >= 0)
    pairs[often] = _found(_pair(before[v[own[often]]], u[own[often]]), hot.pairs)
    groups = np.bincount(gc, minlength=len(before))
    base = np.cumsum(groups) - groups
    types = _pack(
        _thin(word), _thin(heavy + 1), _thin(pairs + 1), _thin(group % len(word)), _thin(groups), _thin(np.bincount(v, minlength=len(before))),
        _thin(g - base[v]), np.packbits(pair), _thin(c),
    )
    return types, _pack(_thin(step), sizes)


def _types(blob: bytes) -> Types:
    word, heavy, pairs, gw, groups, own, g, pair, c = _unpack(blob)
    groups, own, g = _wide(groups), _wide(own), _wide(g)
    g += np.repeat(np.cumsum(groups) - groups, own)
    c2 = np.cumsum(np.unpackbits(pair, count=len(g)), dtype=np.int64) - 1
    return Types(_wide(word), _wide(heavy) - 1, _wide(pairs) - 1, _wide(gw), np.repeat(np.arange(len(groups)), groups), g, c2, _wide(c))


@dataclass
class Totals:
    """Tables and customers of the restaurants: of two previous words, of one, and of the root."""

    t2: np.ndarray
    c2: np.ndarray
    t1: np.ndarray
    c1: np.ndarray
    t0: int
    c0: int


def _totals(types: Types, t2: np.ndarray, k1: np.ndarray, t1: np.ndarray, t0: int, c0: int) -> Totals:
    """Totals of a bucket, as far as it has the restaurants."""
    add = lambda at, x, n: np.bincount(at, weights=x, minlength=n).astype(np.int64)
    n, m = len(types.pairs), len(types.heavy)
    return Totals(add(types.c2, t2, n), add(types.c2, types.c, n), add(types.gc, t1, m), add(types.gc, k1, m), t0, c0)


def seat(c: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int = 1) -> np.ndarray:
    """Tables of each row's ``c`` customers of one word; ``base`` is (strength + discount * tables of
    the restaurant) * the parent's probability of the word."""
    t = (c > 0).astype(np.int64)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        t[many] = _seat_blocks(c[many], base[many], discount, rng)
    for n in range(2, EXACT + 1):
        rows = np.flatnonzero(c == n)
        if len(rows):
            t[rows] = _seat_exact(n, base[rows], discount, rng, sweeps)
    return t


_STIRLING: dict[float, np.ndarray] = {}


def _log_stirling(discount: float) -> np.ndarray:
    """log S(n, t) of all 0 < t <= n <= ``STIRLING``; -inf elsewhere."""
    if discount not in _STIRLING:
        t = np.arange(STIRLING + 1)
        s = np.full((STIRLING + 1, STIRLING + 1), -np.inf, dtype=np.float32)
        s[1, 1] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(1, STIRLING):
                stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)) + s[n], -np.inf)
                s[n + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], s[n, :-1])))
        _STIRLING[discount] = s
    return _STIRLING[discount]


def _seat_blocks(c: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    t = np.minimum(1 + rng.poisson(base / discount), c)
    few = np.flatnonzero(c <= STIRLING)
    few = few[np.argsort(c[few], kind="stable")]
    stirling, tables = _log_stirling(discount), np.arange(STIRLING + 1)
    for at in range(0, len(few), 1024):
        rows = few[at : at + 1024]
        most = int(c[rows].max()) + 1
        p = stirling[c[rows], :most] + np.log(base[rows]).astype(np.float32)[:, None] * tables[:most].astype(np.float32)
        run = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1, dtype=np.float32)
        t[rows] = np.minimum((run < (rng.random(len(rows)) * run[:, -1])[:, None]).sum(axis=1), c[rows])
    return t


def _seat_exact(n: int, base: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int) -> np.ndarray:
    """Explicit tables: every customer sits down, then each in turn leaves and sits down again."""
    m = len(base)
    rows = np.arange(m)
    size = np.zeros((m, n), dtype=np.int8)
    at = np.zeros((m, n), dtype=np.int8)
    for step in range(n * (1 + sweeps)):
        i = step % n
        if step >= n:
            size[rows, at[:, i]] -= 1
        weight = np.where(size > 0, size - discount, 0.0)
        free = np.argmin(size > 0, axis=1)
        weight[rows, free] += base
        run = np.cumsum(weight, axis=1)
        pick = np.minimum((run < (rng.random(m) * run[:, -1])[:, None]).sum(axis=1), n - 1)
        at[:, i] = pick
        size[rows, pick] += 1
    return (size > 0).sum(axis=1)


@dataclass
class Shared:
    """What a seating is given: totals, discounts from the root on, the number of words."""

    totals: Totals
    discounts: tuple[float, float, float]
    v: int

    def __post_init__(self) -> None:
        self.t2, self.c2, self.t1, self.c1 = self.totals.t2, self.totals.c2, self.totals.t1, self.totals.c1
        self.t0, self.c0 = self.totals.t0, self.totals.c0

    def floor(self) -> float:
        return (STRENGTH + self.discounts[0] * self.t0) / (self.v + 1)

    def root(self, k0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        return (np.maximum(k0 - self.discounts[0] * t0, 0) + self.floor()) / (STRENGTH + self.c0)

    def near(self, types: Types, k1: np.ndarray, t1: np.ndarray, p0: np.ndarray) -> np.ndarray:
        d = self.discounts[1]
        back = (STRENGTH + d * self.t1[types.gc]) * p0[types.gw]
        return (np.maximum(k1 - d * t1, 0) + back) / (STRENGTH + self.c1[types.gc])

    def wide(self, types: Types, t2: np.ndarray, p1: np.ndarray) -> np.ndarray:
        d = self.discounts[2]
        back = ((STRENGTH + d * self.t2) / (STRENGTH + self.c2))[types.c2] * p1[types.g]
        return np.maximum(types.c - d * t2, 0) / (STRENGTH + self.c2)[types.c2] + back


@dataclass
class Upper:
    """Of a bucket's words the root's customers and tables; of its groups of hot previous words those
    of the whole restaurants."""

    k0: np.ndarray
    t0: np.ndarray
    k1: np.ndarray
    t1: np.ndarray


def _given(types: Types, t2: np.ndarray, k1: np.ndarray, t1: np.ndarray, sums: np.ndarray, hot: Hot, discounts: tuple, v: int) -> Shared:
    """The bucket's own totals, and the shared ones of hot words, hot pairs and the root."""
    root = hot.at("root")
    own = _totals(types, t2, k1, t1, int(sums[root + 1]), int(sums[root]))
    for which, at, (c, t) in ((types.heavy, ("c1", "t1"), (own.c1, own.t1)), (types.pairs, ("c2", "t2"), (own.c2, own.t2))):
        some = np.flatnonzero(which >= 0)
        c[some], t[some] = sums[hot.at(at[0]) + which[some]], sums[hot.at(at[1]) + which[some]]
    return Shared(own, discounts, v)


def first_tables(types: Types) -> tuple[np.ndarray, np.ndarray]:
    """(t2, t1) with one table for every word of a restaurant; groups of hot previous words have no t1 of their own."""
    t2 = (types.c > 0).astype(np.int64)
    t1 = (types.customers(t2) > 0).astype(np.int64)
    t1[types.hot] = 0
    return t2, t1


def lower(types: Types, last: Shared, upper: Upper, t2: np.ndarray, t1: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t2, k1, t1) drawn after ``t2`` and ``t1``, given the root.  Words of one customer have one table."""
    _, d1, d2 = last.discounts
    p0 = last.root(upper.k0, upper.t0)
    p1 = _near(types, last, types.customers(t2), t1, upper, p0)
    at = types.some
    t2 = (types.c > 0).astype(np.int64)
    t2[at] = seat(types.c[at], (STRENGTH + d2 * last.t2[types.c2[at]]) * p1[types.g[at]], d2, rng)
    k1 = types.customers(t2)
    t1 = (k1 > 0).astype(np.int64)
    t1[types.hot] = 0
    at = np.flatnonzero((k1 > 1) & (t1 > 0))
    t1[at] = seat(k1[at], (STRENGTH + d1 * last.t1[types.gc[at]]) * p0[types.gw[at]], d1, rng)
    return t2, k1, t1


def _near(types: Types, shared: Shared, k1: np.ndarray, t1: np.ndarray, upper: Upper, p0: np.ndarray) -> np.ndarray:
    if len(types.hot):
        k1, t1 = k1.copy(), t1.copy()
        k1[types.hot], t1[types.hot] = upper.k1, upper.t1
    return shared.near(types, k1, t1, p0)


def predict(types: Types, t2: np.ndarray, k1: np.ndarray, t1: np.ndarray, own: Shared, upper: Upper) -> np.ndarray:
    """Probability of every type given its context; ``own`` has the totals of this same seating, so the
    probabilities of all words and of an unknown one add up to 1."""
    return own.wide(types, t2, _near(types, own, k1, t1, upper, own.root(upper.k0, upper.t0)))


def _ask(types: Types, k1: np.ndarray, t1: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, its words with their customers at the root, and those of hot previous words)."""
    k0 = np.bincount(types.gw, weights=t1, minlength=len(types.word)).astype(np.int64)
    order, edges = _by_group(types, groups)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    hw = back[types.gw[types.hot]]
    hot = types.hot[np.argsort(hw, kind="stable")]
    hw = np.sort(hw)
    cuts = np.searchsorted(hw, edges)
    for g in np.flatnonzero(np.diff(edges)).tolist():
        own, there = order[edges[g] : edges[g + 1]], hot[cuts[g] : cuts[g + 1]]
        at = hw[cuts[g] : cuts[g + 1]] - edges[g]
        yield g, _press(np.diff(types.word[own] // groups, prepend=0), k0[own], at, types.heavy[types.gc[there]], k1[there])


def _by_group(types: Types, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket's words by group, each group's in ascending order, and where the groups begin."""
    group = types.word % groups
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(groups + 1))


def _answered(types: Types, groups: int, blobs: list[bytes]) -> Upper:
    """What the groups, in order, answered to ``_ask``."""
    got = [_planes(x) for x in blobs]
    order, _ = _by_group(types, groups)
    k0, t0, k1, t1 = (np.concatenate([_wide(x[i]) for x in got]) for i in range(4))
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    hw = np.argsort(back[types.gw[types.hot]], kind="stable")
    unsort = np.empty(len(hw), dtype=np.int64)
    unsort[hw] = np.arange(len(hw))
    return Upper(k0[back], t0[back], k1[unsort], t1[unsort])


def serve(asked: list[bytes], state: bytes | None, sums: np.ndarray | None, hot: Hot, discounts: tuple | None, v: int, rng: np.random.Generator) -> tuple[list[bytes], bytes, np.ndarray]:
    """Seats the root, and the restaurants of hot previous words, for a group of words: the answers, the
    root's customers and tables, and shared totals.  The first time (no ``state``) every word has one table."""
    got = [_planes(x) for x in asked]
    at = [np.cumsum(_wide(x[0])) for x in got]
    size = max(int(a[-1]) for a in at) + 1
    k0 = np.bincount(np.concatenate(at), weights=np.concatenate([_wide(x[1]) for x in got]), minlength=size).astype(np.int64)
    out = np.zeros(hot.size(), dtype=np.int64)
    root, many = hot.at("root"), max(1, len(hot.words))
    hw = np.concatenate([a[_wide(x[2])] for a, x in zip(at, got)])
    key, which = np.unique(hw * many + np.concatenate([_wide(x[3]) for x in got]), return_inverse=True)
    k1 = np.bincount(which, weights=np.concatenate([_wide(x[4]) for x in got]), minlength=len(key)).astype(np.int64)
    hv = key % many
    if state is None:
        t1 = (k1 > 0).astype(np.int64)
    else:
        last = Shared(Totals(*[np.zeros(0)] * 4, int(sums[root + 1]), int(sums[root])), discounts, v)
        p0 = last.root(*(_wide(x) for x in _planes(state)))[key // many]
        t1 = seat(k1, (STRENGTH + discounts[1] * sums[hot.at("t1") + hv]) * p0, discounts[1], rng)
    k0 += np.bincount(key // many, weights=t1, minlength=size).astype(np.int64)
    t0 = (k0 > 0).astype(np.int64) if state is None else seat(k0, np.full(size, last.floor()), discounts[0], rng)
    np.add.at(out, hot.at("c1") + hv, k1)
    np.add.at(out, hot.at("t1") + hv, t1)
    out[root], out[root + 1] = k0.sum(), t0.sum()
    out[hot.at("ones") + 2 :] = [(x == m).sum() for x in (k1, k0) for m in (1, 2)]
    hots = np.cumsum([0, *[x[2].shape[1] for x in got]])
    answers = [_press(k0[a], t0[a], k1[which[i:j]], t1[which[i:j]]) for a, i, j in zip(at, hots[:-1], hots[1:])]
    return answers, _press(k0, t0), out


def _pair_sums(types: Types, t2: np.ndarray, hot: Hot) -> np.ndarray:
    out = np.zeros(hot.size(), dtype=np.int64)
    if len(hot.pairs):
        at = types.pairs[types.c2]
        some = np.flatnonzero(at >= 0)
        np.add.at(out, hot.at("c2") + at[some], types.c[some])
        np.add.at(out, hot.at("t2") + at[some], t2[some])
    return out


def _discounts(ones: np.ndarray) -> tuple[float, float, float]:
    """n1 / (n1 + 2 n2) of the types of each level, from the root up, kept inside (0, 1)."""
    wide, near, root = ones.reshape(3, 2)
    return tuple(float(np.clip(a / (a + 2 * b) if a + b else 0.5, 0.05, 0.95)) for a, b in (root, near, wide))


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


#: Rows of the tables between the passes: at a chunk, bucket or group of words, from another.
_ROWS = "at long, kind int, source long, blob binary"
_DOCS, _CODES, _WORDS, _IDS, _HOT, _BLOCK, _TYPES, _PLACES, _ASK, _ANSWER, _STATE, _SEATS, _SUMS, _P = range(14)
Row = tuple[int, int, int, bytes]


def _frame(rows: list[Row]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["at", "kind", "source", "blob"])


def _frames(rows: Iterator[Row], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most:
            yield _frame(held)
            held, size = [], 0
    if held:
        yield _frame(held)


Met = dict[int, list[tuple[int, bytes]]]


def _each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Met]]:
    """(at, its rows by kind as (source, blob)) of frames that come in the order of ``at``."""
    own, held = None, {}
    for frame in frames:
        for at, kind, source, blob in zip(frame["at"], frame["kind"], frame["source"], frame["blob"]):
            if at != own and held:
                yield own, held
                held = {}
            own = at
            held.setdefault(kind, []).append((source, blob))
    if held:
        yield own, held


def _meet(run: Callable[[int, Met], Iterator[Row]], parts: int, *tables: DataFrame) -> DataFrame:
    """``run`` on the rows of every ``at``, in the order of their sources."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)

    def all_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(row for at, got in _each(frames) for row in run(at, got))

    return both.repartition(parts, "at").sortWithinPartitions("at", "kind", "source").mapInPandas(all_of, _ROWS)


def _of(table: DataFrame, *kinds: int) -> DataFrame:
    return table.where(F.col("kind").isin(*kinds))


def _sums(size: int, *tables: DataFrame) -> np.ndarray:
    """The sum of all totals of the tables, added up in each task first."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for frame in frames:
            for blob in frame["blob"]:
                total += _unpack(blob)[0]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    parts = [_of(t, _SUMS).select("blob") for t in tables]
    for t in parts[1:]:
        parts[0] = parts[0].unionByName(t)
    out = np.zeros(size, dtype=np.int64)
    for r in parts[0].mapInPandas(local, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def parse(rows: DataFrame, groups: int, most: int) -> DataFrame:
    """Chunks: their documents, their tokens as codes, and their distinct words to the groups of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 20
        for k, train, w, count in _chunks(batches, most):
            word, code = np.unique(np.append(w, _START), return_inverse=True)
            start, code = int(code[-1]), code[:-1]
            n = np.bincount(code, minlength=len(word))
            n[start] += len(count)
            c = np.bincount(code[np.repeat(train, count)], minlength=len(word))
            rank = np.empty(len(word), dtype=np.uint32)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(word), dtype=np.uint32)
            keys = np.array([x if x is not None else 0 for x in k], np.int64), np.array([x is None for x in k])
            yield chunk, _DOCS, 0, _pack(*keys, train, _thin(count))
            # Codes by frequency are small for most tokens; the words' counts tell the order.
            yield chunk, _CODES, 0, _pack(_thin(rank[code]), _thin(n), start)
            edges = np.searchsorted(_deal(word, groups), np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(edges)).tolist():
                x, y = edges[g], edges[g + 1]
                yield g, _WORDS, chunk, _press(word[x:y], n[x:y], c[x:y])
            chunk += 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _frames(run(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    schema = pa.schema([("at", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("blob", pa.binary())])
    return rows.mapInArrow(emit, _ROWS)


def number(groups: int, most: int) -> Callable[[int, Met], Iterator[Row]]:
    """Ids and counts of a group's words, to all chunks that have them; frequent words have small ids."""

    def run(group: int, got: Met) -> Iterator[Row]:
        asked = [_planes(b) for _, b in got[_WORDS]]
        word, at = np.unique(np.concatenate([_wide(x[0], np.uint64) for x in asked]), return_inverse=True)
        n, c = (np.bincount(at, weights=np.concatenate([_wide(x[i]) for x in asked]), minlength=len(word)).astype(np.int64) for i in (1, 2))
        ids = np.empty(len(word), dtype=np.int64)
        ids[np.argsort(-n, kind="stable")] = np.arange(len(word)) * groups + group
        cuts = np.cumsum([0, *[x[0].shape[1] for x in asked]])
        for (chunk, _), x, y in zip(got[_WORDS], cuts[:-1], cuts[1:]):
            own = at[x:y]
            yield int(chunk), _IDS, group, _press(ids[own], n[own], c[own])
        yield group, _SUMS, 0, _pack(np.array([n.sum(), c.sum(), (c > 0).sum()]))
        if (n > most).any():
            yield group, _HOT, 0, ids[n > most].tobytes()

    return run


def _chunk(got: Met) -> tuple[Chunk, np.ndarray]:
    """A chunk of its codes and the answers of the groups; and its words' training counts."""
    rank, often, start = _unpack(got[_CODES][0][1])
    code = np.argsort(-_wide(often), kind="stable").astype(np.int32)[_wide(rank, np.int32)]
    told = [_planes(b) for _, b in got[_IDS]]
    ids, n, c = (np.concatenate([_wide(x[i]) for x in told]) for i in range(3))
    return Chunk(code, _wide(_unpack(got[_DOCS][0][1])[3]), start, ids, n), c


def _hot(parsed: DataFrame, numbered: DataFrame, parts: int, most: int) -> Hot:
    """Previous words and pairs of more than ``most`` tokens: at most one for every ``most`` tokens of the input."""
    words = np.sort(np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["blob"], np.int64) for r in _of(numbered, _HOT).select("blob").collect()]]))
    if len(words) == 0:
        return Hot(words, np.zeros(0, np.uint64), most)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame["blob"]:
                pair, n = (np.frombuffer(x, np.int64) for x in pickle.loads(blob))
                yield pd.DataFrame({"pair": pair, "n": n})

    def pairs(at: int, got: Met) -> Iterator[Row]:
        pair, n = _chunk(got)[0].hot_pairs(most)
        yield at, _HOT, 0, pickle.dumps((pair.tobytes(), n.astype(np.int64).tobytes()))

    found = _meet(pairs, parts, _of(parsed, _CODES, _DOCS), _of(numbered, _IDS)).select("blob").mapInPandas(count, "pair long, n long")
    often = found.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("pair").collect()
    return Hot(words, np.sort(np.array([r["pair"] for r in often], dtype=np.int64).view(np.uint64)), most)


def score_table(
    df: DataFrame, key: str, text: str, samples: int = SAMPLES, bucket_tokens: int = BUCKET_TOKENS, hot_tokens: int = HOT, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = df.sparkSession
    since = runtime.staged()
    rows = df.select(df[key].cast("long").alias("k"), (~held_out(df[key])).alias("train"), df[text].alias("t"))
    with tokens.bounded_batches(spark, BATCH_ROWS), runtime.tidy(spark):
        groups = runtime.parts_for(rows, GROUP_BYTES, 8)
        # Scans dealt over many small tasks would make as many small chunks.
        rows = rows.coalesce(runtime.parts_for(rows, TASK_BYTES, 2 * spark.sparkContext.defaultParallelism))
        parsed = runtime.stage(parse(rows, groups, chunk_tokens), "parsed", by="kind")
        out = _seated(parsed, groups, samples, bucket_tokens, hot_tokens).withColumnRenamed("k", key)
        return runtime.settle(out, "scores", since)


def _seated(parsed: DataFrame, groups: int, samples: int, bucket_tokens: int, hot_tokens: int) -> DataFrame:
    parts = lambda n: max(min(n, 64), n // 4)
    numbered = runtime.stage(_meet(number(groups, hot_tokens), parts(groups), _of(parsed, _WORDS)), "numbered")
    runtime.discard(parsed, below=f"/kind={_WORDS}")
    total, learnt, v = (int(x) for x in _sums(3, numbered))
    buckets = max(8, -(-total // bucket_tokens))
    chunks = parts(buckets)
    hot = _hot(parsed, numbered, chunks, hot_tokens)

    def send(at: int, got: Met) -> Iterator[Row]:
        train = _unpack(got[_DOCS][0][1])[2]
        for bucket, blob in blocks(_chunk(got)[0], train, hot, buckets):
            yield bucket, _BLOCK, at, blob

    def gather(bucket: int, got: Met) -> Iterator[Row]:
        made, places = merge([b for _, b in got[_BLOCK]], hot)
        sources = np.array([s for s, _ in got[_BLOCK]])
        del got
        yield bucket, _TYPES, 0, made
        yield bucket, _PLACES, 0, _pack(sources, places)
        types = _types(made)
        t2, t1 = first_tables(types)
        k1 = types.customers(t2)
        sums = _pair_sums(types, t2, hot)
        alone = np.delete(k1, types.hot)
        sums[hot.at("ones") :][:4] = [(x == m).sum() for x in (types.c, alone) for m in (1, 2)]
        yield bucket, _SUMS, 0, _pack(sums)
        yield from ((g, _ASK, bucket, b) for g, b in _ask(types, k1, t1, groups))

    sent = _meet(send, chunks, _of(parsed, _CODES, _DOCS), _of(numbered, _IDS))
    merged = runtime.stage(_meet(gather, chunks, sent), "buckets")
    made = _of(merged, _TYPES)

    def served(turn: int, asked: DataFrame, *last: DataFrame, sums: np.ndarray | None = None, discounts: tuple | None = None) -> DataFrame:
        def run(group: int, got: Met) -> Iterator[Row]:
            state = got[_STATE][0][1] if _STATE in got else None
            answers, now, own = serve([b for _, b in got[_ASK]], state, sums, hot, discounts, v, np.random.default_rng((turn, 1 << 40, group)))
            yield group, _SUMS, 0, _pack(own)
            yield group, _STATE, turn, now
            for (bucket, _), b in zip(got[_ASK], answers):
                yield int(bucket), _ANSWER, group, b

        return runtime.stage(_meet(run, parts(groups), _of(asked, _ASK), *[_of(t, _STATE) for t in last]), f"words{turn}")

    words = served(0, merged)
    sums = _sums(hot.size(), merged, words)
    discounts = _discounts(sums[hot.at("ones") :])
    seats, kept = None, []

    def sweep(turn: int, sums: np.ndarray):
        def run(bucket: int, got: Met) -> Iterator[Row]:
            types = _types(got[_TYPES][0][1])
            upper = _answered(types, groups, [b for _, b in got[_ANSWER]])
            t2, t1 = (_wide(x) for x in _planes(got[_SEATS][0][1])) if _SEATS in got else first_tables(types)
            last = _given(types, t2, types.customers(t2), t1, sums, hot, discounts, v)
            t2, k1, t1 = lower(types, last, upper, t2, t1, np.random.default_rng((turn, bucket)))
            yield bucket, _SEATS, turn, _press(t2, t1)
            yield bucket, _SUMS, 0, _pack(_pair_sums(types, t2, hot))
            yield from ((g, _ASK, bucket, b) for g, b in _ask(types, k1, t1, groups))

        return run

    for turn in range(1, BURN_IN + samples + 1):
        before = (seats, words)
        seats = runtime.stage(_meet(sweep(turn, sums), chunks, made, _of(words, _ANSWER), *([_of(seats, _SEATS)] if seats is not None else [])), f"seats{turn}")
        words = served(turn, seats, words, sums=sums, discounts=discounts)
        sums = _sums(hot.size(), seats, words)
        if turn > BURN_IN:
            kept.append((turn, seats, words, sums))
        if turn <= BURN_IN + 1:
            runtime.discard(*[t for t in before if t is not None])

    given = [(turn, sums) for turn, _, _, sums in kept]

    def score(bucket: int, got: Met) -> Iterator[Row]:
        types = _types(got[_TYPES][0][1])
        sources, places = _unpack(got[_PLACES][0][1])
        p = np.zeros(len(types.c))
        for turn, sums in given:
            t2, t1 = (_wide(x) for x in _planes(next(b for s, b in got[_SEATS] if s == turn)))
            k1 = types.customers(t2)
            upper = _answered(types, groups, [b for _, b in got[_ANSWER + 100 * turn]])
            p += predict(types, t2, k1, t1, _given(types, t2, k1, t1, sums, hot, discounts, v), upper)
        told = np.log10(p / len(given)).astype(np.float32).view(np.uint32)
        step, sizes = _unpack(places)
        step, at = _wide(step), 0
        for source, n in zip(sources.tolist(), sizes.tolist()):
            yield source, _P, bucket, _press(told[np.cumsum(step[at : at + n])])
            at += n

    told = [_of(w, _ANSWER).withColumn("kind", F.col("kind") + F.lit(100 * turn)) for turn, _, w, _ in kept]
    scored = _meet(score, chunks, _of(merged, _TYPES, _PLACES), *[_of(s, _SEATS) for _, s, _, _ in kept], *told)
    scored = runtime.stage(scored, "probabilities")
    runtime.discard(merged, *[t for _, s, w, _ in kept for t in (s, w)])
    unseen = float(np.log10(learnt + v + 1.0))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, got in _each(frames):
            chunk, c = _chunk(got)
            k, null, train, _ = _unpack(got[_DOCS][0][1])
            order, first, *_ = chunk.arrange(hot, buckets)
            doc = np.repeat(np.arange(len(k)), chunk.count)
            p = np.concatenate([_wide(_planes(b)[0], np.uint32).view(np.float32) for _, b in got[_P]])
            p = np.repeat(p, np.diff(np.append(first, len(order)))).astype(np.float64)
            add = lambda at, x: np.bincount(at, weights=x, minlength=len(k))
            yield pd.DataFrame(
                {
                    "k": pd.array(k, dtype="Int64") if not null.any() else pd.array(np.where(null, None, k), dtype="Int64"),
                    "held_out": ~train, "n_tokens": chunk.count, "n_known": add(doc, (c > 0)[chunk.code]).astype(np.int64), "train_tokens": learnt,
                    "base_score": add(doc, np.log10(c + 1.0)[chunk.code]) - chunk.count * unseen, "score": add(doc[order], p),
                }
            )

    out = "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    last = _of(parsed, _CODES, _DOCS).unionByName(_of(numbered, _IDS)).unionByName(scored)
    return last.repartition(chunks, "at").sortWithinPartitions("at", "kind", "source").mapInPandas(finish, out)
