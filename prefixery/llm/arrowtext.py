"""Vectorised text primitives over Arrow string columns, for use inside tasks.

A partition's Arrow batches are cut into slices of a few megabytes of UTF-8
(``slices``); words, hashes and byte streams of a slice are numpy arrays over
its raw bytes, so no Python string is made.  A null text counts as empty.
Memory per task is bounded by the slice size or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:       # a giant text's tables are not kept
            _powers[name] = have
    return have


class Slice:
    """Consecutive rows of a batch: ``buf`` their UTF-8 bytes, ``off`` the row
    boundaries (len rows + 1), ``rows`` the batch slice with every column."""

    def __init__(self, rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray):
        self.rows, self.buf, self.off = rows, buf, off
        self.n = len(off) - 1

    def lower(self) -> None:
        self.buf = _LOWER[self.buf]

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def ids(self, name: str = "doc_id") -> np.ndarray:
        return np.asarray(pc.fill_null(self.column(name).cast(pa.int64()), 0))

    def segments(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of non-separator bytes within a row: starts, ends, and
        the first segment index of each row (len rows + 1)."""
        inside = ~separator[self.buf]
        size = len(inside)
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.off[:-1]
            before[edges[edges < size]] = False
            last = self.off[1:] - 1
            after[last[last >= 0]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ``[^\\x20\\x09-\\x0D]+``."""
        return self.segments(_SPACE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges (polynomial prefix sums, then mixed)."""
        size = len(self.buf)
        total = np.zeros(size + 1, U64)
        np.cumsum((self.buf.astype(U64) + U64(1)) * _power("up", _BASE, size)[:size], out=total[1:])
        h = (total[ends] - total[starts]) * _power("down", _BASE_INV, size + 1)[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[Slice]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(col):
            end = int(np.searchsorted(off, off[row] + limit, "right")) - 1
            end = min(max(end, row + 1), len(col))
            yield Slice(batch.slice(row, end - row), raw[off[row]:off[end]], off[row:end + 1] - off[row])
            row = end
        del batch, col, offsets, data, off, raw
    release()


def release() -> None:
    """Give freed memory back at the end of a partition: Spark keeps the worker
    for later stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices of all full windows of ``size`` consecutive segments within
    a row, and the row of each."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    base = np.cumsum(count) - count
    return np.arange(len(row)) - base[row] + first[row], row


_WINDOW_KEYS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def window_hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` consecutive segment hashes."""
    out = np.zeros(len(at), U64)
    for k in range(size):
        out += h[at + k] * _WINDOW_KEYS[k]
    return mix(out + U64(size))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per-row sums of segment values (rows may be empty)."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def stream(s: Slice, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' token streams, one after another: ``pad`` end marks (0x0A, which
    no word holds), the words joined by one space, one end mark.  Returns the
    bytes and the offset of each row's first byte after the padding, closed by
    the end (row r spans ``at[r] .. at[r + 1] - pad``)."""
    starts, ends, first = s.words()
    size = ends - starts
    n = np.diff(first)
    length = sums(size, first) + np.maximum(n, 1) + pad
    at = np.concatenate([[0], np.cumsum(length)]) + pad
    out = np.full(int(at[-1] - pad), 0x0A, np.uint8)
    row = np.repeat(np.arange(s.n), n)
    before = np.cumsum(size) - size
    rel = before - (before[np.minimum(first[:-1], max(len(size) - 1, 0))][row] if len(size) else 0)
    to = at[row] + rel + np.arange(len(size)) - first[row]
    where = np.repeat(to - before, size) + np.arange(int(size.sum()))
    out[where] = s.buf[np.repeat(starts - before, size) + np.arange(int(size.sum()))]
    inner = np.ones(len(size), bool)
    inner[first[1:][n > 0] - 1] = False
    out[(to + size)[inner]] = 0x20
    return out, at


def grams(out: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed ``order``-byte grams ending at every stream byte but the padding
    (``pad`` = order - 1), last byte lowest, and the row boundaries."""
    g = np.zeros(len(out), np.int64)
    for k in range(order):
        g[order - 1:] |= out[order - 1 - k:len(out) - k].astype(np.int64) << (8 * k)
    pad = order - 1
    keep = np.ones(len(out), bool)
    for k in range(pad):
        keep[at[:-1] - 1 - k] = False
    length = np.diff(at) - pad
    return g[keep], np.concatenate([[0], np.cumsum(length)])


class Counter:
    """Counts of 64-bit keys over a partition, merged as they grow."""

    def __init__(self, merge_at: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.merge_at = 0, merge_at

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > self.merge_at:
            self.merge()
            self.merge_at = max(self.merge_at, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        if len(keys):
            counts, keys = np.add.reduceat(counts, edge), keys[edge]
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


class HashArrays:
    """Sorted arrays of mixed 64-bit keys with parallel values.

    The mix is a bijection, so equal hashes mean equal keys; its uniformity lets
    the leading bits find a key's bucket, which is then read forward."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        h = mix(keys.view(U64))
        order = np.argsort(h)
        self.hash = h[order]
        self.values = [v[order] for v in values]
        bits = max(1, int(len(h)).bit_length())
        self.shift = U64(64 - bits)
        edges = np.arange(1 << bits, dtype=U64) << self.shift
        self.start = np.append(np.searchsorted(self.hash, edges), len(h)).astype(np.int32)

    @classmethod
    def built(cls, hash: np.ndarray, start: np.ndarray, *values: np.ndarray) -> HashArrays:
        """From the arrays of one."""
        self = cls.__new__(cls)
        self.hash, self.start, self.values = hash, start, list(values)
        self.shift = U64(65 - len(start).bit_length())
        return self

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its first value (0 where not)."""
        at = self.find(keys)
        known = at >= 0
        out = np.zeros(len(keys), self.values[0].dtype)
        out[known] = self.values[0][at[known]]
        return known, out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.hash):
            for k in range(0, len(keys), 1 << 15):     # blocks that stay in a core's cache
                self._find(keys[k:k + (1 << 15)], out[k:k + (1 << 15)])
        return out

    def _find(self, keys: np.ndarray, out: np.ndarray) -> None:
        h = mix(keys.view(U64))
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket].astype(np.int64), self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        h, at, end = h[left], at[left], end[left]
        while len(left):
            hit = self.hash[at] == h
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            left, h, at, end = left[go], h[go], at[go], end[go]
