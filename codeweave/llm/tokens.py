"""Exact, cached use of the public tokenizers inside Arrow batches.

A text is cut only where the tokenizer's own pre-tokenizer must cut as well: after a word, so that a
piece is a word with the ASCII white space before it, or the white space at the end of a text.  A
tokenizer that drops white space and folds case is given bare words.  Pieces are found, hashed and
looked up for a whole batch at a time; each distinct piece is encoded once by the tokenizers library
and its ids are kept in a bounded table per worker.

Texts in which a cut could go wrong (white space outside ASCII, a special token's ``<|``, NUL) are
encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codeweave import runtime
from codeweave.llm import shingles

_WHOLE = "[\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<\\|"
#: Distinct pieces that one Python worker keeps; further ones are encoded again when met.
CACHE_PIECES = 2_000_000
#: Bytes of the longest piece that is kept; longer ones are rare and hashed ids would not be safe.
LONGEST = 64
#: Words that are encoded in one call.
TOGETHER = 64
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Table:
    """An open-addressing map from 64-bit hashes to id lists, all in flat arrays."""

    def __init__(self, dtype: np.dtype, room: int) -> None:
        self.bits = max(10, int(np.ceil(np.log2(room * 1.6))))
        self.room, self.used = room, 0
        # Untouched pages of a zeroed array cost no memory.
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int64)
        self.length = np.zeros(1 << self.bits, np.uint16)
        self.ids = np.empty(1 << 16, dtype)
        self.n_ids = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes; -1 where absent."""
        slot = self._slot(h)
        got = self.key[slot]
        out = np.where(got == h, slot, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.key[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def store(self, ids: np.ndarray) -> int:
        """Append ids; returns where they start."""
        at = self.n_ids
        if at + len(ids) > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), at + len(ids)), self.ids.dtype)
            grown[:at] = self.ids[:at]
            self.ids = grown
        self.ids[at : at + len(ids)] = ids
        self.n_ids = at + len(ids)
        return at

    def insert(self, h: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Enter distinct hashes that are absent."""
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.at[slot[put]], self.length[slot[put]] = h[put], at[put], length[put]
            left = np.ones(len(h), bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.used += len(h)


class Encoder:
    """Token ids of texts as little-endian unsigned integers of ``width`` bytes.

    ``drops_space``: the tokenizer ignores white space and folds case, as a word-level one does.
    """

    def __init__(self, path: str, drops_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.drops_space = drops_space
        self.table = Table(self.dtype, CACHE_PIECES)

    def _pieces(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every piece, in order."""
        start, end = shingles.spans(flat, off)
        text = np.searchsorted(off, start, side="right") - 1
        if self.drops_space:
            return start, end, text
        begin = np.concatenate(([0], end[:-1])) if len(end) else start
        start = np.maximum(begin, off[text])
        last = off[:-1].copy()
        last[text] = end  # the last word of a text is assigned last
        blank = np.flatnonzero(last < off[1:])
        if len(blank):
            start, end, text = np.concatenate([start, last[blank]]), np.concatenate([end, off[1:][blank]]), np.concatenate([text, blank])
            order = np.argsort(start, kind="stable")
            start, end, text = start[order], end[order], text[order]
        return start, end, text

    def _make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each has): pieces that start with white space and hold a
        word are encoded many at a time and cut apart by their offsets, others one by one."""
        joined = [i for i, p in enumerate(pieces) if self.drops_space or p[0].isspace() and not p.isspace()]
        made: list[np.ndarray] = [np.empty(0, self.dtype)] * len(pieces)
        gap = " " if self.drops_space else ""
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for at in range(0, len(groups), 16):
            some = groups[at : at + 16]
            texts = [gap.join([pieces[i] for i in g]) for g in some]
            for group, enc in zip(some, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                first = np.cumsum([0, *[len(pieces[i]) + len(gap) for i in group]])
                cuts = np.searchsorted(np.array([o[0] for o in enc.offsets]), first).tolist()
                flat = np.array(enc.ids, dtype=self.dtype)
                for i, a, b in zip(group, cuts[:-1], cuts[1:]):
                    made[i] = flat[a:b]
        known = set(joined)
        alone = [i for i in range(len(pieces)) if i not in known]
        for i, enc in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
            made[i] = np.array(enc.ids, dtype=self.dtype)
        return np.concatenate(made) if made else np.empty(0, self.dtype), np.array([len(x) for x in made], dtype=np.int64)

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of every text of a string array; null is empty."""
        flat, off = shingles.buffers(column)
        if self.drops_space:
            flat = shingles.fold(flat)  # the tokenizer folds case itself; folding ASCII early makes words repeat
        whole = pc.match_substring_regex(column, _WHOLE).fill_null(False).to_numpy(zero_copy_only=False)
        start, end, text = self._pieces(flat, off)
        if whole.any():
            keep = ~whole[text]
            start, end, text = start[keep], end[keep], text[keep]
        table, size = self.table, end - start
        h = shingles.hashes(flat, start, end)
        h[h == 0] = 1
        slot = table.find(h)
        slot[size > LONGEST] = -1
        at, length = table.at[slot], table.length[slot].astype(np.int64)
        lacking = np.flatnonzero(slot < 0)
        held = table.n_ids
        if len(lacking):
            raw = flat.tobytes()
            short = lacking[size[lacking] <= LONGEST]
            new, first, inverse = np.unique(h[short], return_index=True, return_inverse=True)
            own = short[first]
            ids, n = self._make([raw[a:b].decode() for a, b in zip(start[own].tolist(), end[own].tolist())])
            where = table.store(ids) + np.cumsum(n) - n
            at[short], length[short] = where[inverse], n[inverse]
            k = min(len(new), table.room - table.used)
            if k:
                table.insert(new[:k], where[:k], n[:k])
                held = int(where[k - 1] + n[k - 1])
            long = lacking[size[lacking] > LONGEST]
            if len(long):
                ids, n = self._make([raw[a:b].decode() for a, b in zip(start[long].tolist(), end[long].tolist())])
                at[long], length[long] = table.store(ids) + np.cumsum(n) - n, n
        run = np.concatenate(([0], np.cumsum(length)))
        out = table.ids[np.repeat(at - run[:-1], length) + np.arange(run[-1])]
        table.n_ids = held  # ids that the table did not take are given up
        cuts = run[np.searchsorted(text, np.arange(len(off)))].tolist()
        found = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        odd = np.flatnonzero(whole).tolist()
        if odd:
            for i, enc in zip(odd, self.tokenizer.encode_batch_fast(column.take(pa.array(odd)).to_pylist(), add_special_tokens=False)):
                found[i] = np.array(enc.ids, dtype=self.dtype).tobytes()
        return found


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each is about ``max_bytes``, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def bounded_batches(spark, rows: int = 500):
    """Arrow batches small enough for very long texts, for the jobs run inside."""
    return runtime.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
