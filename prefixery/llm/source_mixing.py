"""Mixing sources to target weights by proportionate-fair scheduling.

A source's documents, in the order of their ids, are cut into blocks of
``BLOCK``.  With target weight w, block i of a source is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); one block is placed per slot,
always the released one with the earliest deadline.  Weights are integers a_s
over their sum Q, by default so large that rounding them moves no block: over N
slots it amounts to less than N / Q of a block.  The driver goes through the slots
once, with a heap of the sources, and writes them out in pieces (``PIECE`` blocks of
a source, ``HELD`` slots at a time), to which the documents are joined.  At every
slot of a phase each source is less than one block away from its share.

A source that runs out ends the phase; the next phase goes on with the others at
their relative weights, so every document is placed and none is repeated.

Positions within a source come from a range shuffle of the rows' keys (source, id,
hash of the text): they are numbered within their partition and source, and the
partitions' counts (one row per partition and source) are summed up, so that no task
holds a whole source.  Texts are not part of this: the positions are joined to the
documents by key, broadcast while they are few.

Defined results: a null source is the source "".  Rows with equal ids follow the
hash of their texts.  An empty table gives no rows.  Target weights for absent
sources are ignored; a source without a positive weight raises an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

BLOCK = 64
QUANTUM = 1 << 31          # block number times quantum fits 63 bits
PIECE = 4096               # blocks of a source per row of the plan
HELD = 1 << 20             # slots on the driver at a time; more are written out
BROADCAST_SLOTS = 4 << 20  # a plan of more is joined by shuffle
BROADCAST_ROWS = 500_000   # as are the positions of more rows (60 bytes each)
TEMPERATURE = 0.5
ADDED = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]


def integer_weights(weights: dict[str, float], quantum: int = QUANTUM) -> dict[str, int]:
    """Largest-remainder shares of ``quantum`` units (or of four per source, if
    that is more), at least one each."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a positive target weight")
    total, units = sum(map(Fraction, weights.values())), max(quantum, 4 * len(weights))
    exact = {s: Fraction(w) / total * units for s, w in weights.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in order[:max(0, units - sum(share.values()))]:
        share[s] += 1
    for _ in range(sum(share.values()) - units):                # what the least shares were given
        share[max(share, key=lambda s: (share[s] - exact[s], share[s], s) if share[s] > 1 else (-units, 0, s))] -= 1
    return share


def _placed(share: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first among the
    released."""
    q, slot = sum(share.values()), 0
    waiting = [(0, s, 0) for s in sorted(share)]               # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []                      # deadline, source, block
    while share:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * q // share[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, ((i + 1) * q // share[s], s, i + 1))
        slot += 1


def period(share: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period."""
    slots: dict[str, list[int]] = {s: [] for s in share}
    for slot, s in enumerate(islice(_placed(share), sum(share.values()))):
        slots[s].append(slot)
    return slots


def pieces(docs: dict[str, int], share: dict[str, int], block: int) -> Iterator[tuple]:
    """Rows (source, piece, from, to, first, slot0, position0, q, a, slots): blocks
    from..to-1 of the source, all with the same number by ``PIECE``, lie in a
    phase that starts at slot0 and position0 and with block ``first``; their slots
    count from slot0."""
    left = {s: -(-n // block) for s, n in docs.items() if n}
    done = dict.fromkeys(left, 0)
    slot0, position0 = 0, 0
    while left:
        own = {s: share[s] for s in left}
        first, held, q = {s: done[s] for s in left}, {s: [] for s in left}, sum(own.values())

        def row(s):
            return (s, (done[s] - 1) // PIECE, done[s] - len(held[s]), done[s], first[s], slot0, position0, q, own[s], held[s])

        for slot, s in enumerate(_placed(own)):
            held[s].append(slot)
            done[s] += 1
            left[s] -= 1
            if not done[s] % PIECE:
                yield row(s)
                held[s] = []
            if not left[s]:
                break
        yield from [row(s) for s in own if held[s]]
        slot0 += slot + 1
        position0 += (slot + 1) * block - (-docs[s] % block)     # its last block may be short
        del left[s]


def phases(docs: dict[str, int], share: dict[str, int], block: int) -> list[tuple]:
    """Rows (source, from, to, slot0, position0, q, a, slots): the pieces of each
    phase and source in one."""
    out: dict[tuple, tuple] = {}
    for s, _, a, b, first, slot0, position0, q, n, slots in pieces(docs, share, block):
        have = out.get((s, slot0), (None,) * 7 + ([],))[-1]
        out[s, slot0] = (s, first, b, slot0, position0, q, n, have + slots)
    return list(out.values())


_PLAN = pa.schema([("mix_source", pa.string()), *[(c, pa.int64()) for c in (
    "mix_piece", "mix_from", "mix_to", "mix_first", "slot0", "position0", "q", "a")], ("slots", pa.list_(pa.int32()))])


def _plan(spark, docs: dict[str, int], share: dict[str, int], block: int) -> DataFrame:
    """The pieces as a table, written out whenever ``HELD`` slots are there."""
    def frame(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(_PLAN)
        return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, _PLAN, strict=True)], schema=_PLAN))

    out, rows, size = None, [], 0
    for r in pieces(docs, share, block):
        rows.append(r)
        size += len(r[-1])
        if size >= HELD:
            part = stored(frame(rows), "mixing-plan")
            out, rows, size = part if out is None else out.unionByName(part), [], 0
    return out.unionByName(frame(rows)) if out is not None else frame(rows)


def tempered(docs: DataFrame, temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights in proportion to a power of each source's characters."""
    rows = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()    # a row per source
    return {r["source"]: max(1, r["n"]) ** temperature for r in rows}


_KEYS = ["mix_source", "mix_id", "mix_tie"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(row: struct of all columns, and the row's key)."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("source", F.lit("")).alias("mix_source"),
                       docs["doc_id"].alias("mix_id"), (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("mix_tie"))


def _numbered(keys: DataFrame) -> DataFrame:
    """Rows with their key columns, mix_index (number within the source by key) and
    mix_copy (number among rows of equal keys)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields) + ", mix_part int, mix_row long, mix_copy long"

    def run(batches):
        part, seen, last, copies = TaskContext.get().partitionId(), {}, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("mix_source").dictionary_encode()
            index = np.asarray(codes.indices)
            row = np.zeros(len(index), np.int64)
            for k, name in enumerate(codes.dictionary.to_pylist()):
                mine = np.flatnonzero(index == k)
                row[mine] = np.arange(len(mine)) + seen.get(name, 0)
                seen[name] = seen.get(name, 0) + len(mine)
            key = list(zip(*[b.column(c).to_pylist() for c in _KEYS], strict=True))
            copy = np.zeros(len(index), np.int64)
            for k, own in enumerate(key):
                copies = copies + 1 if own == last else 0
                copy[k], last = copies, own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(index), part, np.int32)), pa.array(row), pa.array(copy)],
                                             [*b.schema.names, "mix_part", "mix_row", "mix_copy"])

    ranged = stored(keys.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema), "mixing-ranged")
    sizes = ranged.groupBy("mix_source", "mix_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (ranged.join(sizes, ["mix_source", "mix_part"])
            .withColumn("mix_index", F.col("mix_row") + F.col("before")).drop("mix_part", "mix_row", "before"))


def _positions(keys: DataFrame, counts: dict[str, int], share: dict[str, int], block: int) -> DataFrame:
    """The keys with mix_copy and ``ADDED``, stored."""
    numbered = _numbered(keys)
    plan = _plan(keys.sparkSession, counts, share, block)
    few = sum(-(-n // block) for n in counts.values()) <= BROADCAST_SLOTS
    slot = F.element_at("slots", (F.col("mix_block") - F.col("mix_from") + 1).cast("int")).cast("long")
    placed = (numbered.withColumn("mix_block", F.expr(f"div(mix_index, {block})"))
              .withColumn("piece", F.expr(f"div(mix_block, {PIECE})"))
              .join(F.broadcast(plan) if few else plan, [
                  numbered["mix_source"] == plan["mix_source"], F.col("piece") == F.col("mix_piece"),
                  F.col("mix_block") >= F.col("mix_from"), F.col("mix_block") < F.col("mix_to")])
              .drop(plan["mix_source"]))
    return stored(placed.select(
        *keys.columns, "mix_copy", "mix_block",
        (F.col("slot0") + F.expr("div((mix_block - mix_first) * q, a)")).alias("mix_release"),
        (F.col("slot0") + F.expr("div((mix_block - mix_first + 1) * q + a - 1, a)")).alias("mix_deadline"),
        (F.col("slot0") + slot).alias("mix_slot"),
        (F.col("position0") + slot * block + F.col("mix_index") % block).alias("mix_position")), "mixing-positions")


def _with_positions(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (row and key) with the positions of their keys.  Rows of equal keys are
    numbered first; others are not moved for that."""
    named = dict(zip(_KEYS, ("at_source", "at_id", "at_tie"), strict=True))
    same = ((F.col("mix_source") == F.col("at_source")) & F.col("mix_id").eqNullSafe(F.col("at_id"))
            & (F.col("mix_tie") == F.col("at_tie")))
    placed = placed.withColumnsRenamed(named)
    twice = placed.where("mix_copy = 1").select(*named.values())
    if twice.limit(1).count():
        many = rows.join(twice, same, "left_semi")
        order = Window.partitionBy(*_KEYS).orderBy(F.xxhash64("row"))
        many = many.withColumn("copy", (F.row_number().over(order) - 1).cast("long"))
        rows = rows.join(twice, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(many)
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    side = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    return rows.join(side, same & (F.col("copy") == F.col("mix_copy"))).select("row.*", "mix_source", *ADDED[1:])


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK,
             quantum: int = QUANTUM) -> DataFrame:
    """The documents (columns of these names are replaced) with mix_source, mix_block, mix_release, mix_deadline,
    mix_slot and mix_position (0, 1, ... in scheduled order).  Without given
    weights, sources are weighted by the square root of their characters."""
    docs = small_batches(docs).drop(*ADDED)
    weights = tempered(docs) if weights is None else {s or "": w for s, w in weights.items()}
    counts = {r["source"]: r["n"] for r in docs.groupBy(F.coalesce("source", F.lit("")).alias("source"))
              .agg(F.count("*").alias("n")).collect()}                          # a row per source
    share = integer_weights({s: weights.get(s, 0) for s in counts}, quantum) if counts else {}
    rows = _keyed(docs)
    if "text" not in docs.columns:
        return _positions(rows, counts, share, block).select("row.*", *ADDED)
    return _with_positions(rows, _positions(rows.select(*_KEYS), counts, share, block))


def largest_deviation(share: dict[str, int]) -> Fraction:
    """Largest difference over one period between blocks placed and due."""
    q, slots, worst = sum(share.values()), period(share), Fraction(0)
    for s, own in slots.items():
        for t in range(q + 1):
            placed = int(np.searchsorted(own, t))
            worst = max(worst, abs(placed - Fraction(share[s] * t, q)))
    return worst


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All documents, with their own columns, in scheduled order."""
    placed = schedule(docs, **options).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return placed.select(*docs.columns)


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = schedule(docs.select("doc_id", "source"), weights=tempered(docs))
    return placed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_release").alias("release"),
                         F.col("mix_deadline").alias("deadline"), F.col("mix_slot").alias("slot"),
                         F.col("mix_position").alias("position"))
