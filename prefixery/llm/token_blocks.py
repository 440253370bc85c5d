"""Token-ID output in patched frame-of-reference blocks.

Documents are sorted (by doc_id, or by given columns) through a range shuffle,
encoded whole, closed by an end id, and written as segments: rows of a Parquet
table with the segment's documents and a binary payload, so that any store that
Spark reaches can hold them.  A segment ends at a document's end once it holds
``SEGMENT`` ids.

Payload (little-endian): ``PFOR``, uint32 ids, blocks, exceptions; per block its
minimum (uint32), width (uint8), first payload word (uint32) and first exception
(uint32, one more closes the list); per exception its position in the block
(uint16) and delta (uint32); then the 64-bit words.  A block holds ``BLOCK`` ids
(the last is filled with its minimum).  The width is that of the ``QUANTILE``
delta; lanes of 64 deltas take ``width`` words; larger deltas are exceptions.

Only the token count of each partition is gathered (one row per partition) to
turn positions within a partition into global ones.

Defined results: a null or empty text is the end id alone.  A null doc_id sorts
first.  Repeated rows are all written, in the order of their texts' hashes.  An
empty table gives no rows.  Columns other than doc_id, text and the order are
ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixery.session import scratch_path

from .arrowtext import slices
from .chunk_encoder import default_vocabulary, encoder
from .common import small_batches, table

BLOCK = 512
SEGMENT = 1 << 18
QUANTILE = 0.9
END_ID = 2
_LANE = 64
_MAGIC = b"PFOR"


# ------------------------------------------------------------------ the blocks

def _lanes(width: int) -> list[tuple[int, int]]:
    return [(k * width // _LANE, k * width % _LANE) for k in range(_LANE)]


def _pack(delta: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64) deltas below 2 ** width to (rows, width) words."""
    words = np.zeros((len(delta), width), np.uint64)
    for k, (word, shift) in enumerate(_lanes(width) if width else ()):
        words[:, word] |= delta[:, k] << np.uint64(shift)
        if shift + width > _LANE:
            words[:, word + 1] |= delta[:, k] >> np.uint64(_LANE - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    delta = np.zeros((len(words), _LANE), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k, (word, shift) in enumerate(_lanes(width) if width else ()):
        v = words[:, word] >> np.uint64(shift)
        if shift + width > _LANE:
            v = v | (words[:, word + 1] << np.uint64(_LANE - shift))
        delta[:, k] = v & mask
    return delta


def _bits(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids to a payload."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[(blocks - 1) * BLOCK:].min()
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = (full - least[:, None]).astype(np.uint64)
    at = int(QUANTILE * (BLOCK - 1))
    width = _bits(np.partition(delta, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    block, place = np.nonzero(delta >> width[:, None].astype(np.uint64))
    patch = delta[block, place]
    delta[block, place] = 0
    lanes = BLOCK // _LANE
    first = np.concatenate([[0], np.cumsum(width * lanes)])
    words = np.zeros(int(first[-1]), "<u8")
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        packed = _pack(delta[mine].reshape(-1, _LANE), int(w)).reshape(len(mine), -1)
        words[first[mine][:, None] + np.arange(packed.shape[1])] = packed
    return b"".join([
        _MAGIC, struct.pack("<III", n, blocks, len(patch)), least.astype("<u4").tobytes(), width.astype("u1").tobytes(),
        first[:-1].astype("<u4").tobytes(), np.searchsorted(block, np.arange(blocks + 1)).astype("<u4").tobytes(),
        place.astype("<u2").tobytes(), patch.astype("<u4").tobytes(), words.tobytes()])


def decode_blocks(payload: bytes) -> np.ndarray:
    """A payload's ids."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a PFOR payload")
    n, blocks, patches = struct.unpack_from("<III", payload, 4)
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    least, width, first = take("<u4", blocks), take("u1", blocks), take("<u4", blocks).astype(np.int64)
    edge, place, patch = take("<u4", blocks + 1), take("<u2", patches), take("<u4", patches)
    words = np.frombuffer(payload, "<u8", -1, at)
    delta = np.zeros((blocks, BLOCK), np.uint64)
    lanes = BLOCK // _LANE
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        packed = words[first[mine][:, None] + np.arange(lanes * int(w))]
        delta[mine] = _unpack(packed.reshape(-1, int(w)), int(w)).reshape(len(mine), BLOCK)
    delta[np.repeat(np.arange(blocks), np.diff(edge)), place] = patch
    return (delta.astype(np.uint32) + least[:, None]).reshape(-1)[:n]


# ------------------------------------------------------------- write and read

_SEGMENTS = ("part int, segment int, first long, n_tokens long, doc_ids array<long>, lengths array<int>, data binary")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, order: tuple[str, ...] = ("doc_id",),
          end_id: int = END_ID) -> None:
    """Encode and write the documents in ascending order of ``order``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        part = TaskContext.get().partitionId()
        segment, first = 0, 0
        ids, lengths, docs_in, held = [], [], [], 0

        def flush():
            nonlocal segment, first, ids, lengths, docs_in, held
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first]), pa.array([held]),
                pa.array([pa.concat_arrays(docs_in).to_pylist()], pa.list_(pa.int64())),
                pa.array([np.concatenate(lengths)], pa.list_(pa.int32())),
                pa.array([encode_blocks(np.concatenate(ids))], pa.binary())],
                ["part", "segment", "first", "n_tokens", "doc_ids", "lengths", "data"])
            segment, first = segment + 1, first + held
            ids, lengths, docs_in, held = [], [], [], 0
            return row

        coder = encoder(vocabulary)
        for s in slices(batches):
            (found,), edge = coder.encode(s)
            closed = np.insert(found, edge[1:], end_id)
            ids.append(closed)
            lengths.append((np.diff(edge) + 1).astype(np.int32))
            docs_in.append(s.column("doc_id").cast(pa.int64()))
            held += len(closed)
            if held >= SEGMENT:
                yield flush()
        if held:
            yield flush()

    ties = [c for c in (F.col("doc_id"), F.xxhash64("text"), F.col("text"))]
    by = [F.col(c) for c in order] + ties[:2]
    (small_batches(docs).repartitionByRange(*by).sortWithinPartitions(*[F.col(c) for c in order], *ties)
     .select("doc_id", "text").mapInArrow(run, _SEGMENTS).write.parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    from pyspark.sql import Window
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))        # a row per written partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = {r["part"]: r["before"] for r in sizes.select("part", before.alias("before")).collect()}

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                part, _, first, n, docs, lengths, data = (b.column(c)[k] for c in range(7))
                ids = decode_blocks(data.as_py()).astype("<u4")
                size = np.asarray(lengths.values).astype(np.int64)
                end = np.cumsum(size)
                at = (end - size).tolist()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at, end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(end - size + first.as_py() + starts[part.as_py()]), pa.array(size),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id and its ids, the end id included."""
    files = spark.read.schema(_SEGMENTS).parquet(path)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                docs, lengths, data = (b.column(c)[k] for c in (4, 5, 6))
                edge = np.concatenate([[0], np.cumsum(np.asarray(lengths.values))]).astype(np.int32)
                ids = pa.array(decode_blocks(data.as_py()).astype(np.int32))
                yield pa.RecordBatch.from_arrays([docs.values, pa.ListArray.from_arrays(edge, ids)], ["doc_id", "ids"])

    return files.mapInArrow(run, "doc_id long, ids array<int>")


def tokenized(docs: DataFrame, order: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back."""
    path = scratch_path(docs.sparkSession, "token-blocks")
    write(docs, path, vocabulary, order)
    return read(docs.sparkSession, path)


def op4_token_blocks(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
