"""Benchmark decontamination by q-gram filtering and banded alignment.

Text and benchmark items are read as bytes: A-Z lower-cased, white space runs
one space.  A document is contaminated when a stretch of ``WINDOW`` bytes of an
item occurs in it with at most ``ERRORS`` insertions, deletions and substitutions.  A
shorter item has to occur whole, with one edit for each 25 bytes that it has (none
below 25); one of less than ``Q`` bytes as it is, between word ends.

Q-gram lemma: such an occurrence shares at least WINDOW + 1 - Q (ERRORS + 1)
q-grams with the stretch, all within ERRORS + 1 neighbouring diagonals (position
in the text less position in the item).  Hits are counted in bands of ``BAND``
diagonals that overlap by ERRORS, so that some band holds them all; bands with
enough hits close together are kept.  Verification extends each exact run of a
kept band to both sides in a band of ERRORS diagonals (furthest reach per number
of edits) and accepts when the reaches within the edit budget span the window.

The benchmark's q-gram index goes to every task; it is built over groups of
items of at most ``GROUP_BYTES`` of text, with a pass over the documents for
each group, so its size has a bound at any benchmark size.  Documents need no
shuffle: each is scanned whole within its partition.

Defined results: null and empty texts, and an empty benchmark, give no hits.
Items without words are not searched.  Null ids stay
null; repeated rows are scanned each.  Columns other than the ids and texts are
ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, slices, stream
from .common import small_batches, stored, table

Q = 12
WINDOW = 50
ERRORS = 2
BAND = 8
GROUP_BYTES = 16 << 20
_TABLE_BITS = 22
SHORT_EDIT = 25            # bytes of a short item per edit
_ENDS = np.array([0x20, 0x0A], np.uint8)


def _qgrams(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes from each position (len - Q + 1)."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = np.zeros(len(b) - 7, np.uint64)
    for k in range(8):
        low |= b[k:len(b) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    return low[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (low[Q - 8:Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))


class Index:
    """Q-grams of the items: a bit table by leading hash bits, the sorted
    hashes, and the places (item, position) of each."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [i for i, _ in items]
        self.texts = [t for _, t in items]
        h, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, t in enumerate(self.texts):
            g = _qgrams(np.frombuffer(t, np.uint8))
            h.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        h, item, at = np.concatenate(h), np.concatenate(item), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.bits = np.zeros(1 << _TABLE_BITS, bool)
        self.bits[self._slot(self.hash)] = True
        size = np.array([len(t) for t in self.texts], np.int64)
        self.window = np.minimum(size, WINDOW)
        self.errors = np.where(size >= WINDOW, ERRORS, size // SHORT_EDIT)
        self.least = self.window + 1 - Q * (self.errors + 1)

        self.short: dict[int, dict[bytes, list[int]]] = {}       # items of less than Q bytes by length
        for k, t in enumerate(self.texts):
            if len(t) < Q:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(k)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def hits(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of all shared q-grams."""
        h = _qgrams(b)
        place = np.flatnonzero(self.bits[self._slot(h)]) if len(h) else np.zeros(0, np.int64)
        found = np.searchsorted(self.hash, h[place])
        ok = self.hash[np.minimum(found, len(self.hash) - 1)] == h[place] if len(self.hash) else np.zeros(0, bool)
        place, found = place[ok], found[ok]
        many = self.first[found + 1] - self.first[found]
        pick = np.repeat(self.first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(place, many), self.item[pick], self.at[pick]


def _kept(index: Index, p: np.ndarray, item: np.ndarray, at: np.ndarray):
    """Hits in bands that hold enough of them within a window's reach."""
    d = p - at + (1 << 40)
    band = d // BAND
    edge = np.flatnonzero(d % BAND < ERRORS)                 # also counted in the band below
    p, item, at = (np.concatenate([x, x[edge]]) for x in (p, item, at))
    band = np.concatenate([band, band[edge] - 1])
    order = np.lexsort((p, band, item))
    p, item, at, band = p[order], item[order], at[order], band[order]
    key = mix(item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ band.astype(np.uint64))
    keep = np.zeros(len(p), bool)
    least, reach = index.least[item], (index.window + index.errors - Q)[item]
    for t in np.unique(least):
        i = np.flatnonzero(least == t)
        last = i + t - 1
        i, last = i[last < len(p)], last[last < len(p)]
        ok = (key[i] == key[last]) & (p[last] - p[i] <= reach[i])
        for a in i[ok]:
            keep[a:a + t] = True
    return p[keep], item[keep], at[keep]


def _reach(a: bytes, b: bytes, errors: int) -> list[int]:
    """Longest prefix of ``b`` that matches a prefix of ``a`` within 0..errors
    edits: furthest-reaching points on the diagonals of a band."""
    def run(x: int, y: int) -> int:
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
        return y

    out, now = [], {0: run(0, 0)}                            # diagonal x - y: furthest y
    out.append(now[0])
    for _ in range(errors):
        nxt: dict[int, int] = {}
        for diagonal, y in now.items():
            for shift, dy in ((0, 1), (1, 0), (-1, 1)):      # substitution, extra byte in a, missing byte in a
                d, y2 = diagonal + shift, y + dy
                if y2 <= len(b) and 0 <= y2 + d <= len(a):
                    nxt[d] = max(nxt.get(d, 0), run(y2 + d, y2))
        now = {d: max(nxt.get(d, 0), now.get(d, 0)) for d in {*nxt, *now}}
        out.append(max(now.values()))
    return out


def _verified(index: Index, text: bytes, p: int, item: int, at: int, size: int) -> tuple[int, int] | None:
    """(item bytes covered, edits) around an exact run of ``size`` bytes, if they
    span the item's window."""
    own, errors = index.texts[item], int(index.errors[item])
    span = len(own) + errors
    right = _reach(text[p + size:p + size + span], own[at + size:], errors)
    left = _reach(text[max(0, p - span):p][::-1], own[:at][::-1], errors)
    best = max(((left[k] + size + right[e - k], -e) for e in range(errors + 1) for k in range(e + 1)))
    return (best[0], -best[1]) if best[0] >= index.window[item] else None


def _short(index: Index, text: np.ndarray, at: np.ndarray):
    """(row, item, (item bytes, 0)) of the shortest items, word by word."""
    first = np.flatnonzero(np.isin(text[:-1], _ENDS) & ~np.isin(text[1:], _ENDS)) + 1
    for size, items in index.short.items():
        place = first[first + size < len(text)]
        place = place[np.isin(text[place + size], _ENDS)]
        own = np.ascontiguousarray(text[place[:, None] + np.arange(size)]).view(f"S{size}").ravel()
        place = place[np.isin(own, np.array(list(items), f"S{size}"))]
        rows = np.searchsorted(at, place, "right") - 1
        for p, row in zip(place.tolist(), rows.tolist(), strict=True):
            for item in items.get(text[p:p + size].tobytes(), ()):
                yield row, item, (size, 0)


def _found(index: Index, text: np.ndarray, at: np.ndarray, pad: int):
    """(row, item, item bytes covered, edits) per verified place."""
    p, item, j = _kept(index, *index.hits(text))
    if not len(p):
        return
    order = np.lexsort((p, p - j, item))
    p, item, j = p[order], item[order], j[order]
    run = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | ((p - j)[1:] != (p - j)[:-1]) | (p[1:] > p[:-1] + 1)]))
    last = np.append(run[1:], len(p)) - 1
    rows = np.searchsorted(at, p[run], "right") - 1
    for a, b, row in zip(run.tolist(), last.tolist(), rows.tolist(), strict=True):
        lo, hi = int(at[row]), int(at[row + 1]) - pad
        body = text[lo:hi].tobytes()
        ok = _verified(index, body, int(p[a]) - lo, int(item[a]), int(j[a]), int(p[b] - p[a]) + Q)
        if ok:
            yield row, int(item[a]), ok


def _normal(s) -> tuple[np.ndarray, np.ndarray]:
    s.lower()
    out, at = stream(s, Q)           # Q end marks apart: no q-gram of an item spans two rows
    return out, at


def _benchmark_groups(benchmark: DataFrame):
    """Group condition per pass: items dealt by hash into groups of bounded text."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = 1 + total // GROUP_BYTES
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    return [benchmark.where("text IS NOT NULL").where(group == g) for g in range(groups)] if total else []


def _index(items: DataFrame) -> Index:
    rows = items.select("item_id", "text").toArrow()
    out = []
    for s in slices(rows.to_batches()):
        text, at = _normal(s)
        for k, i in enumerate(s.column("item_id").to_pylist()):
            own = text[at[k]:at[k + 1] - Q - 1].tobytes()    # without the end mark
            if own:
                out.append((i, own))
    return Index(out)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, items (found items, sorted),
    longest (most item bytes covered), edits (of that place)."""
    return _matches(docs, benchmark).drop("mark")


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    groups = _benchmark_groups(benchmark)
    docs = small_batches(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("line"), F.xxhash64("text").alias("mark"))
    out = None
    for items in groups or [None]:
        index = spark.sparkContext.broadcast(_index(items) if items is not None else Index([]))

        def run(batches, index=index):
            ids = index.value.items
            for s in slices(batches):
                text, at = _normal(s)
                found: dict[int, dict] = {}
                for row, item, place in chain(_found(index.value, text, at, Q), _short(index.value, text, at)):
                    best = found.setdefault(row, {})
                    best[item] = max(best.get(item, (0, 0)), (place[0], -place[1]))
                top = [max(found[r].values()) if r in found else (0, 0) for r in range(s.n)]
                yield pa.RecordBatch.from_arrays([
                    s.column("line"), s.column("doc_id").cast(pa.int64()), s.column("mark"),
                    pa.array([sorted(ids[k] for k in found.get(r, ())) for r in range(s.n)], pa.list_(pa.int64())),
                    pa.array([t[0] for t in top], pa.int64()), pa.array([-t[1] for t in top], pa.int64())],
                    ["line", "doc_id", "mark", "items", "longest", "edits"])

        one = docs.mapInArrow(run, "line long, doc_id long, mark long, items array<long>, longest long, edits long")
        out = one if out is None else out.unionByName(one)
    if len(groups) > 1:
        out = out.groupBy("line", "doc_id", "mark").agg(
            F.array_sort(F.flatten(F.collect_list("items"))).alias("items"),
            F.max(F.struct("longest", (-F.col("edits")).alias("e"))).alias("best")).select(
            "doc_id", "mark", "items", F.col("best.longest").alias("longest"), (-F.col("best.e")).alias("edits"))
    return out.select("doc_id", "mark", (F.size("items") > 0).alias("contaminated"), "items", "longest", "edits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their own columns (found
    by id and hash of the text)."""
    bad = _matches(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), "mark").distinct()
    bad = stored(bad, "decontaminate-hits")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["mark"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
