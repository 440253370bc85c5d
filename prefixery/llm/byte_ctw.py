"""LM scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z) and read as its token stream: the words joined by
one space and closed by an end mark, so that the model and the unigram base
score the same events.  Every byte is decomposed into eight binary decisions.
Each of the 255 decision nodes has a context tree over the preceding 0..depth
bytes whose nodes hold the counts of zeros and ones in the training documents.
A node's Krichevsky-Trofimov estimate is mixed with its children's:

    Pw(s) = 1/2 KT(s) + 1/2 prod_c Pw(s c),   Pw(s) = KT(s) at full depth,

bottom-up by grouped sums.  Top-down, the posterior probability that the tree
stops at a node weighs that node's prediction, which gives one probability per
full context and decision, and their product one per byte gram.  Grams met only
in held-out texts take part with zero counts (they predict 1/2 below the
deepest trained context), so each gram to score has its row in the model.

The documents are dealt to blocks of some ``BLOCK_BYTES`` of text.  Each block sends its
distinct grams and words with their counts, packed, to pieces by the keys' hashes, where
they are summed up.  All counts cover all documents.  A word that
occurs once in the training documents stays in the word table only if a held-out
text has it too: met in a training document, a word that the table lacks can
only be that document's own.  The gram and word tables go to the tasks as sorted
hash arrays, in pieces, while they hold at most ``broadcast_rows`` rows (24 bytes
each).  Beyond that each block gets back the values of its own keys alone, with the same
result: what moves are the texts and a table for each block, not the grams of each
document.

Defined results: a null text is empty; an empty or blank text has one token,
its end mark.  A null doc_id hashes as the empty string and stays null.
Repeated rows are scored (and counted) each for itself.  Without any training
document N = V = 0, so that the base gives every token 1 / 1, and every
decision has probability 1/2.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, Counter, HashArrays, Slice, grams, mix, signed, slices, stream, sums
from .common import by_arrow, discard, packed_suffix, small_batches, stored
from .shared_arrays import Held, SharedArrays, shared_arrays

WORD, GRAM = 0, 1
END = np.array([0x454E44], np.int64)          # the end token's key in the word counts
BROADCAST_ROWS = 8_000_000
PIECE_GRAMS = 1 << 18         # grams of a call that builds or reads the deepest nodes
BLOCK_BYTES = 1 << 26         # of text in a block of documents, less where there are few
LEAST_BYTES = 1 << 22
PIECE_BYTES = 1 << 24         # of text per piece of the blocks' keys
TABLES = 8                    # hash arrays of a block's table, built one after another
_PACKED_ROWS = 256


def prepared(docs: DataFrame, held_out_mod: int = 7, held_out_rest: int = 2) -> DataFrame:
    """(doc_id, text, held_out): the split by crc32 of the id."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", (crc % held_out_mod == held_out_rest).alias("held_out"))


def _planes(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte: most of these are zeros, which shuffle files and
    Parquet compress."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys: the steps between them."""
    return _planes(np.diff(keys, prepend=0))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data))


def _piece(key: np.ndarray, pieces: int) -> np.ndarray:
    return (mix(key.view(U64)) & U64(pieces - 1)).astype(np.int32)


def _dealt(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``docs`` with their ``block``, the number of blocks, and of pieces of the keys."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, n_bytes // BLOCK_BYTES, min(tasks, n_bytes // LEAST_BYTES))
    docs = small_batches(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return docs, blocks, max(TABLES, 1 << (n_bytes // PIECE_BYTES).bit_length())


def _block_keys(docs: DataFrame, depth: int, blocks: int, pieces: int) -> DataFrame:
    """(kind, piece, block, keys, counts): the distinct words, with the end mark, and
    (depth + 1)-byte grams of each block, which is a partition; twice the training
    count, odd if the word occurs in held-out texts."""
    def rows_of(block: int, kind: int, counter: Counter):
        keys, count = counter.merge()
        piece = _piece(keys, pieces)
        order = np.argsort(piece, kind="stable")
        keys, count, piece = keys[order], count[order], piece[order]
        edge = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]]))
        for k in range(0, len(edge) - 1, _PACKED_ROWS):
            own = list(zip(edge[k:k + _PACKED_ROWS], edge[k + 1:k + 1 + _PACKED_ROWS], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), kind, np.int8)), pa.array(piece[[x for x, _ in own]]),
                 pa.array(np.full(len(own), block, np.int32)), pa.array([_pack(keys[x:y]) for x, y in own], pa.binary()),
                 pa.array([_planes(count[x:y]) for x, y in own], pa.binary())],
                ["kind", "piece", "block", "keys", "counts"])

    def run(batches):
        words, held, found, block = Counter(), Counter(), Counter(), None
        for s in slices(batches):
            s.lower()
            block = s.column("block")[0].as_py()
            train = ~np.asarray(s.column("held_out"))
            starts, ends, first = s.words()
            in_train = np.repeat(train, np.diff(first))
            for counter, keys in ((words, signed(s.hashes(starts[in_train], ends[in_train]))), (words, np.repeat(END, train.sum()))):
                keys, count = np.unique(keys, return_counts=True)
                counter.add(keys, 2 * count)
            out = np.unique(signed(s.hashes(starts[~in_train], ends[~in_train])))
            held.add(out, np.zeros(len(out), np.int64))
            g, row = grams(*stream(s, depth), depth + 1)
            in_train = np.repeat(train, np.diff(row))
            keys, count = np.unique(g[in_train], return_counts=True)
            found.add(keys, 2 * count)
            rest = np.unique(g[~in_train])
            found.add(rest, np.zeros(len(rest), np.int64))
        if block is not None:
            out = held.merge()[0]
            words.add(out, np.ones(len(out), np.int64))
            words.add(END, np.zeros(1, np.int64))
            yield from rows_of(block, WORD, words)
            yield from rows_of(block, GRAM, found)

    dealt = docs.repartitionById(blocks, F.col("block"))
    return stored(by_arrow(dealt, run, "kind tinyint, piece int, block int, keys binary, counts binary"), "ctw-block-keys")


def counts(keys: DataFrame) -> DataFrame:
    """(kind, key, cnt, held): training counts of words and of (depth + 1)-byte
    grams; ``held`` words occur in held-out texts.  What only these have counts 0."""
    def merge(rows: pa.Table) -> pa.Table:
        key = np.concatenate([_unpack(x.as_py()) for x in rows.column("keys")])
        count = np.concatenate([_from_planes(x.as_py()) for x in rows.column("counts")])
        order = np.argsort(key)
        key, count = key[order], count[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return pa.table({"kind": np.full(len(edge), rows.column("kind")[0].as_py(), np.int8), "key": key[edge],
                         "cnt": np.add.reduceat(count >> 1, edge), "held": np.maximum.reduceat(count & 1, edge).astype(bool)})

    merged = keys.groupBy("kind", "piece").applyInArrow(merge, "kind tinyint, key long, cnt long, held boolean")
    return stored(merged, "ctw-counts")


def _lgamma(x):
    shifted, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return ((shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, 3.0)) + 1 / (1260 * F.pow(shifted, 5.0))
            - F.log(product))


def _kt(n0, n1):
    """Natural log of the Krichevsky-Trofimov probability of the counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _decisions(key: np.ndarray):
    """Per decision of the grams' last byte: its nodes (context bytes and decision) and bits."""
    x = key & 255
    for k in range(8):
        yield (key >> 8 << 8) | (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1


def _by_context(rows: DataFrame, context, pieces: int):
    return rows.withColumn("piece", F.pmod(F.xxhash64(context), F.lit(pieces))).groupBy("piece")


def _deepest(found: DataFrame, pieces: int) -> DataFrame:
    """(node, n0, n1) at full depth."""
    def build(rows: pa.Table) -> pa.Table:
        key, cnt = np.asarray(rows.column("key")), np.asarray(rows.column("cnt"))
        out = []
        for node, bit in _decisions(key):
            order = np.argsort(node, kind="stable")
            node, bit, n = node[order], bit[order], cnt[order]
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            n1 = np.add.reduceat(n * bit, edge)
            out.append((node[edge], np.add.reduceat(n, edge) - n1, n1))
        return pa.table(dict(zip(("node", "n0", "n1"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return _by_context(found.select("key", "cnt"), F.shiftright("key", 8), pieces).applyInArrow(build, "node long, n0 long, n1 long")


def _logs(found: DataFrame, path: DataFrame, pieces: int) -> DataFrame:
    """(key, logp) from the probabilities ``acc`` of a one at the deepest nodes."""
    def read(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        key, node, acc = (np.asarray(c) for c in (rows.column("key"), nodes.column("node"), nodes.column("acc")))
        order = np.argsort(node)
        node, acc, logp = node[order], acc[order], np.zeros(len(key))
        for own, bit in _decisions(key):
            one = acc[np.searchsorted(node, own)] if len(node) else own
            logp += np.log10(np.where(bit == 1, one, 1 - one))
        return pa.table({"key": key, "logp": logp})

    return (_by_context(found.select("key"), F.shiftright("key", 8), pieces)
            .cogroup(_by_context(path, F.shiftright("node", 8), pieces)).applyInArrow(read, "key long, logp double"))


def _parent(depth: int):
    """The node one context byte shorter (the oldest byte goes)."""
    ctx = packed_suffix(F.shiftright("node", 8), depth)
    return F.shiftleft(ctx, 8).bitwiseOR(F.col("node").bitwiseAND(255))


def gram_table(found: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(key, logp): log10 probability of each gram's last byte in its context, and the
    stored table that it reads."""
    pieces = 1 + found.count() // PIECE_GRAMS
    level = (_deepest(found, pieces).withColumn("lw", _kt(F.col("n0"), F.col("n1"))).withColumn("stop", F.lit(1.0)))
    levels = {depth: stored(level, f"ctw-level{depth}")}
    for d in range(depth - 1, -1, -1):
        up = (levels[d + 1].groupBy(_parent(d).alias("node"))
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
              .withColumn("kt", _kt(F.col("n0"), F.col("n1"))))
        both = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below"))))
        up = (up.withColumn("lw", both + math.log(0.5))
              .withColumn("stop", F.exp(F.col("kt") + math.log(0.5) - F.col("lw")))
              .select("node", "n0", "n1", "lw", "stop"))
        levels[d] = stored(up, f"ctw-level{d}")
    one_here = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    path = stored(levels[0].select("node", (F.col("stop") * one_here).alias("acc"), (1 - F.col("stop")).alias("rest")), "ctw-path0")
    discard(levels[0])
    for d in range(1, depth + 1):
        above = path.select(F.col("node").alias("above"), F.col("acc").alias("acc0"), F.col("rest").alias("rest0"))
        up, path = path, stored(
            levels[d].select("node", "n0", "n1", "stop").withColumn("above", _parent(d - 1)).join(above, "above")
            .select("node", (F.col("acc0") + F.col("rest0") * F.col("stop") * one_here).alias("acc"),
                    (F.col("rest0") * (1 - F.col("stop"))).alias("rest")), f"ctw-path{d}")
        discard(up, levels[d])
    return _logs(found, path.select("node", "acc"), pieces), path


def fit(keys: DataFrame, depth: int = 5) -> tuple[DataFrame, int, int]:
    """From ``_block_keys``: the model rows (kind, key, value), and N and V of the unigram base.
    ``value``: a word's training count, or the gram's log10 probability."""
    counted = counts(keys)
    words = counted.where((F.col("kind") == WORD) & (F.col("cnt") > 0))
    total, distinct = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    base = words.where("cnt > 1 OR held").select("kind", "key", F.col("cnt").cast("double").alias("value"))
    found, path = gram_table(counted.where(F.col("kind") == GRAM), depth)
    model = found.select(F.lit(GRAM).cast("tinyint").alias("kind"), "key", F.col("logp").alias("value"))
    model = stored(base.unionByName(model), "ctw-model")
    discard(counted, path)
    return model, total, distinct


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
           "score double, n_bytes long")


def _arrays(model: DataFrame, kind: int, as_type: type) -> SharedArrays:
    return shared_arrays(
        model.where(F.col("kind") == kind).select("key", "value"),
        lambda rows: (np.asarray(rows.column("key")), np.asarray(rows.column("value")).astype(as_type)),
        as_type, f"ctw-arrays{kind}")


def _scored(s: Slice, words, found, depth: int, size: int) -> pa.RecordBatch:
    """The rows of a slice, lower-cased, by the lookups of its words and grams."""
    held = np.asarray(s.column("held_out"))
    starts, ends, first = s.words()
    known, count = words.look(signed(s.hashes(starts, ends)))
    c = np.repeat((~held).astype(np.int64), np.diff(first))       # a training text's own word at least
    c[known] = count[known]
    ends_known = words.look(END)[1][0]
    own_end = np.where(held, ends_known, max(ends_known, 1))
    g, row = grams(*stream(s, depth), depth + 1)
    return pa.RecordBatch.from_arrays([
        s.column("doc_id").cast(pa.int64()), s.column("held_out"),
        pa.array(np.diff(first) + 1),
        pa.array(sums((c > 0).astype(np.int64), first) + (own_end > 0)),
        pa.array(sums(np.log10((c + 1) / size), first) + np.log10((own_end + 1) / size)),
        pa.array(sums(found.look(g)[1], row)),
        pa.array(np.diff(row))],
        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def _by_arrays(docs: DataFrame, model: DataFrame, depth: int, size: int) -> DataFrame:
    words, found = _arrays(model, WORD, np.int64), _arrays(model, GRAM, np.float64)

    def run(batches):
        for s in slices(batches):
            s.lower()
            yield _scored(s, words, found, depth, size)

    return by_arrow(docs, run, _SCORES)


def _block_values(keys: DataFrame, model: DataFrame, pieces: int) -> DataFrame:
    """(block, kind, piece, keys, vals): the blocks' keys that the model has, with its values."""
    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_piece(np.asarray(b.column("key")), pieces))],
                                             [*b.schema.names, "piece"])

    def look(packed: pa.Table, rows: pa.Table) -> pa.Table:
        known, value = np.asarray(rows.column("key")), np.asarray(rows.column("value"))
        order = np.argsort(known)
        known, value = known[order], value[order]
        out = []
        for data in packed.column("keys"):
            own = _unpack(data.as_py())
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            out.append((_pack(own[hit]), _planes(value[at[hit]])))
        return pa.table({**{c: packed.column(c) for c in ("block", "kind", "piece")},
                         **{c: pa.array([x[k] for x in out], pa.binary()) for k, c in enumerate(("keys", "vals"))}})

    dealt = model.select("kind", "key", "value").mapInArrow(deal, "kind tinyint, key long, value double, piece int")
    return (keys.groupBy("kind", "piece").cogroup(dealt.groupBy("kind", "piece"))
            .applyInArrow(look, "block int, kind tinyint, piece int, keys binary, vals binary"))


def _by_blocks(docs: DataFrame, keys: DataFrame, blocks: int, pieces: int, model: DataFrame, depth: int, size: int) -> DataFrame:
    values = _block_values(keys.drop("counts"), model, pieces)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in docs.select("doc_id", "text", "held_out").dtypes]
    rows = values.withColumn("rank", F.lit(0)).select("*", *none).unionByName(
        docs.withColumn("rank", F.lit(1)), allowMissingColumns=True)

    def run(batches):
        own: dict[tuple[int, int], list] = {}

        def texts():
            for b in batches:
                n = int(np.searchsorted(np.asarray(b.column("rank")), 1))
                kind, piece = (np.asarray(b.column(c).slice(0, n)) for c in ("kind", "piece"))
                for k in range(n):
                    own.setdefault((kind[k], piece[k] % TABLES), []).append([b.column(c)[k].as_buffer() for c in ("keys", "vals")])
                if n < b.num_rows:
                    yield b.slice(n).select(["doc_id", "text", "held_out"])

        def table(kind: int, dtype: type) -> SharedArrays:
            parts = []
            for k in range(TABLES):
                rows = own.pop((kind, k), [])
                parts.append(HashArrays(
                    np.concatenate([np.zeros(0, np.int64), *(_unpack(x) for x, _ in rows)]),
                    np.concatenate([np.zeros(0), *(_from_planes(x).view(np.float64) for _, x in rows)]).astype(dtype)))
            return SharedArrays([Held(x) for x in parts], dtype)

        words = found = None
        for s in slices(texts()):
            if words is None:
                words, found = table(WORD, np.int64), table(GRAM, np.float64)
            s.lower()
            yield _scored(s, words, found, depth, size)

    return rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("rank").mapInArrow(run, _SCORES)


def score(docs: DataFrame, depth: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte (the model's code length)."""
    docs, blocks, pieces = _dealt(prepared(docs))
    keys = _block_keys(docs, depth, blocks, pieces)
    model, total, distinct = fit(keys, depth)
    size = total + distinct + 1
    if model.count() <= broadcast_rows:
        discard(keys)
        scored = _by_arrays(docs.drop("block"), model, depth, size)
    else:
        scored = _by_blocks(docs, keys, blocks, pieces, model, depth, size)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
                         "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op8_byte_ctw(spark, sf_dir: str) -> DataFrame:
    from .common import table
    return score(table(spark, sf_dir, "documents"))
