"""Key-value tables of models as hash arrays on all tasks.

The entries are dealt by their keys' hashes to pieces of about ``PIECE_ROWS``.
Tasks sort each piece; the driver passes the pieces on one after another, so its
memory holds one of them, however many entries the model has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, HashArrays, mix, release
from .common import by_arrow, stored

PIECE_ROWS = 1 << 18      # entries of a piece, 20 to 24 bytes each
MAX_PIECES = 1 << 15
_BLOCK = 1 << 17

Entries = tuple[np.ndarray, np.ndarray]


def _piece(keys: np.ndarray, pieces: int) -> np.ndarray:
    """The low bits of the hash; within a piece the leading ones stay uniform."""
    return (mix(keys.view(U64)) & U64(pieces - 1)).astype(np.int16)


class Held:
    """A piece that is in the task itself, in the place of a broadcast one."""

    def __init__(self, value: HashArrays):
        self.value = value


class SharedArrays:
    """Broadcast pieces, a power of two of them; values of ``dtype`` (64 bits)."""

    def __init__(self, parts: list, dtype: type):
        self.parts, self.dtype = parts, dtype

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its value (0 where not)."""
        known, out = np.zeros(len(keys), bool), np.zeros(len(keys), self.dtype)
        parts = [p.value for p in self.parts]
        for k in range(0, len(keys), _BLOCK):
            own = keys[k:k + _BLOCK]
            piece = _piece(own, len(parts))
            order = np.argsort(piece, kind="stable")
            edges = np.searchsorted(piece[order], np.arange(len(parts) + 1))
            for part, low, high in zip(parts, edges[:-1], edges[1:]):
                at = order[low:high]
                known[k + at], out[k + at] = part.look(own[at])
        return known, out


def shared_arrays(rows: DataFrame, entries: Callable[[pa.RecordBatch], Entries], dtype: type, name: str) -> SharedArrays:
    """The ``entries`` (keys, 64-bit values) of all batches of ``rows``, at most one a
    row.  Equal keys have equal values; one stays."""
    n, pieces = rows.count(), 1
    while pieces * PIECE_ROWS < n and pieces < MAX_PIECES:
        pieces *= 2

    def deal(batches):
        for batch in batches:
            keys, values = entries(batch)
            keys, one = np.unique(keys, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_piece(keys, pieces)), pa.array(keys), pa.array(values[one].view(np.int64))],
                ["piece", "key", "value"])

    def build(table):
        keys, one = np.unique(np.asarray(table.column("key")), return_index=True)
        arrays = HashArrays(keys, np.asarray(table.column("value"))[one])
        return pa.table({"piece": table.column("piece").slice(0, 1),
                         **{c: pa.array([a.tobytes()], pa.binary()) for c, a in
                            (("hash", arrays.hash), ("start", arrays.start), ("value", arrays.values[0]))}})

    dealt = by_arrow(rows, deal, "piece short, key long, value long")
    built = stored(dealt.groupBy("piece").applyInArrow(build, "piece short, hash binary, start binary, value binary"), name)
    parts = []
    for k in range(pieces):
        part = HashArrays(np.zeros(0, np.int64), np.zeros(0, dtype))
        found = built.where(F.col("piece") == k).select("hash", "start", "value").toArrow()      # one row or none
        if found.num_rows:
            part = HashArrays.built(*(np.frombuffer(column[0].as_buffer(), kind) for column, kind in
                                      zip(found.columns, (U64, np.int32, dtype))))
        parts.append(rows.sparkSession.sparkContext.broadcast(part))
    release()
    return SharedArrays(parts, dtype)
