"""Prefix trie of conversations by burst tries.

A turn (role, text) is named by 16 bytes (MD5 of both); a conversation is the path
of its turns' names.  The trie's nodes are the distinct first d turns.

1. Equal paths are one class: its least conv_id, its number of conversations, and the
   SHA-256 of their ids.  The ids are packed in a range shuffle on (path, conv_id), so
   a frequent conversation is dealt to many tasks and only its packed ids meet.
2. Shards hold suffix containers under trie heads, at first all suffixes under the
   root.  A container of more than ``LIMIT`` suffixes bursts by the next turn's name:
   its head becomes a burst node, each next turn heads a container.  ``STEP`` levels
   are counted at a time (counts are combined before they move), rounds go on while
   containers are too large.
3. The containers that remain are dealt to tasks by their heads, sorted, and swept:
   neighbours' common prefix says which nodes end.  A task holds one path of open
   nodes and what waits for its parent's least member.
4. Burst nodes add up what lies below them: each container head is added to all its
   ancestors, with partial sums before the shuffle; so is what burst nodes save.

Defined results: a null role or text is empty.  Rows with a null conv_id are ignored;
turns that are equal within a conversation are ordered by their names, a null turn
comes first, repeated rows are repeated turns.  c % 5 has the sign of c.  An empty
table gives no rows.  Other columns are ignored.  A row holds one conversation's names
(20 bytes a turn), whatever its length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

NAME = 16                  # bytes of a turn's name
LIMIT = 64                 # suffixes of a container
STEP = 8                   # levels counted in one round
SHARED = 8                 # a conversation takes at most this many turns from another
_NONE = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


# ------------------------------------------------------------- conversations as paths

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (name, size) in order)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    one = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), name.alias("name"),
                 F.octet_length(text).alias("size")).alias("t"))
    return (one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size"))).alias("turns")))


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of (conv_id, turns)."""
    return sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5 in place of its own
    first h, h = crc32(c) % 9; as (conv_id, path, sizes)."""
    own = stored(turns(conversations), "trie-turns")
    head = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(head, "base", "left").withColumn("h", h)
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return paths(both.select("conv_id", F.concat(taken, rest).alias("turns")))


# --------------------------------------------------------------------- equal paths

_RUN = "path binary, sizes array<int>, first long, n long, ids binary"
_CLASS = "path binary, sizes array<int>, conv_id long, n_convs long, ends_sha256 string"


def _runs(batches):
    """Neighbours of equal path, with their ids as text."""
    for b in batches:
        if not b.num_rows:
            continue
        path, ids = b.column(1), b.column(0).to_pylist()
        new = [True, *pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_pylist()]
        edge = [k for k, x in enumerate(new) if x] + [len(new)]
        at = pa.array(edge[:-1])
        yield pa.RecordBatch.from_arrays(
            [path.take(at), b.column(2).take(at), b.column(0).take(at),
             pa.array([y - x for x, y in zip(edge, edge[1:], strict=False)], pa.int64()),
             pa.array([",".join(map(str, ids[x:y])).encode() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())],
            ["path", "sizes", "first", "n", "ids"])


def _closed(batches):
    """Runs of one path, in order of their ids, as one class."""
    held = None
    for b in batches:
        out = []
        for path, sizes, first, n, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0] == path:
                held[3] += n
                held[4].update(b"," + ids)
                continue
            if held:
                out.append((*held[:4], held[4].hexdigest()))
            held = [path, sizes, first, n, hashlib.sha256(ids)]
        if out:
            yield _batch(out, _CLASS)
    if held:
        yield _batch([(*held[:4], held[4].hexdigest())], _CLASS)


_TYPES = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [n for n, _ in fields])


def classes(sequences: DataFrame) -> DataFrame:
    """One row per distinct path: path, sizes, conv_id (the least), n_convs,
    ends_sha256."""
    sequences = stored(sequences, "trie-paths")
    packed = (sequences.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
              .select("conv_id", "path", "sizes").mapInArrow(_runs, _RUN))
    return stored(packed.repartition("path").sortWithinPartitions("path", "first").mapInArrow(_closed, _CLASS), "trie-classes")


# ------------------------------------------------------------------------- bursting

def _prefix(k: str) -> F.Column:
    return F.expr(f"substring(path, 1, {NAME} * {k})")


def burst_nodes(paths_: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(prefix, depth, size) of the heads whose containers burst, round by round;
    their number is at most the paths' turns over ``limit``."""
    depth = F.expr(f"div(length(path), {NAME})")
    left, low, out = paths_.select("path", "sizes"), 0, None
    while True:
        counted = (left.select("path", "sizes", F.explode(F.sequence(F.lit(low), F.least(depth, F.lit(low + step - 1)).cast("int")))
                               .alias("depth"))
                   .select(_prefix("depth").alias("prefix"), F.col("depth").cast("long").alias("depth"),
                           F.when(F.col("depth") > 0, F.get("sizes", F.col("depth") - 1)).alias("size"))
                   .groupBy("prefix", "depth").agg(F.count("*").alias("suffixes"), F.max("size").alias("size")))
        large = stored(counted.where(F.col("suffixes") > limit).select("prefix", "depth", "size"), "trie-burst")
        out = large if out is None else out.unionByName(large)
        low += step
        deepest = large.where(F.col("depth") == low - 1).select("prefix")
        if not deepest.limit(1).count():
            return out
        deeper = left.where(depth >= low).withColumn("prefix", _prefix(str(low - 1)))
        left = stored(deeper.join(deepest, "prefix", "left_semi").select("path", "sizes"), "trie-left")


# -------------------------------------------------------------------------- sweeping

_SWEPT = NODE + ", head binary"


class _Node:
    __slots__ = ("size", "n", "conv", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, size: int):
        self.size, self.n, self.conv, self.children, self.leaves, self.saved = size, 0, None, 0, 0, 0
        self.ends, self.waiting = _NONE, []


def _sweep(batches):
    """Nodes of containers: rows (head, level, path, sizes, conv_id, n_convs, ends),
    sorted by head and path.  Heads keep their prefix in ``head``; their parent is
    not known here."""
    out: list[tuple] = []
    head, level, last, open_ = None, 0, b"", []

    def close(to: int) -> None:
        """Close the open nodes below the first ``to``."""
        while len(open_) > to:
            node = open_.pop()
            depth = level + len(open_)
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            out.extend((c, d, node.conv, *rest, None) for c, d, *rest in node.waiting)
            row = (node.conv, depth, node.n, node.children, node.leaves, node.saved, node.ends)
            if not open_:
                out.append((row[0], depth, None, *row[2:], head))
                continue
            up = open_[-1]
            up.n, up.conv = up.n + node.n, node.conv if up.conv is None else min(up.conv, node.conv)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
            up.waiting.append(row)

    for b in batches:
        for own, at, path, sizes, conv, n, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if own != head:
                close(0)
                head, level, last = own, at, own
                open_.append(_Node(sizes[at - 1] if at else 0))
            same, most = level, min(len(last), len(path)) // NAME
            while same < most and last[NAME * same:NAME * same + NAME] == path[NAME * same:NAME * same + NAME]:
                same += 1
            close(same - level + 1)
            open_.extend(_Node(size) for size in sizes[same:])
            node, last = open_[-1], path
            node.n, node.ends = node.n + n, ends
            node.conv = conv if node.conv is None else min(node.conv, conv)
            if len(out) > 4096:
                yield _batch(out, _SWEPT)
                out.clear()
    close(0)
    if out:
        yield _batch(out, _SWEPT)


# --------------------------------------------------------------------------- the trie

def trie(sequences: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """One row per node (``NODE``) of (conv_id, path, sizes)."""
    whole = classes(sequences)
    burst = stored(burst_nodes(whole, limit, step), "trie-bursts")
    deepest = burst.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    depth = F.expr(f"div(length(path), {NAME})")
    # burst prefixes of a path are its first ones: their number is the level of its head
    levels = (whole.select("conv_id", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.least(depth, F.lit(deepest)))).alias("k"))
              .select("conv_id", _prefix("k").alias("prefix")).join(burst.select("prefix"), "prefix")
              .groupBy("conv_id").agg(F.count("*").alias("level"))) if deepest >= 0 else None
    placed = whole.join(levels, "conv_id") if levels is not None else whole.withColumn("level", F.lit(0).cast("long"))
    placed = stored(placed.withColumn("head", _prefix("level")), "trie-placed")
    swept = stored(placed.where(depth >= F.col("level"))
                   .select("head", "level", "path", "sizes", "conv_id", "n_convs", "ends_sha256")
                   .repartition("head").sortWithinPartitions("head", "path").mapInArrow(_sweep, _SWEPT), "trie-swept")
    below = swept.where("head IS NULL").drop("head")
    heads = swept.where("head IS NOT NULL")
    if deepest < 0:
        return below.unionByName(heads.drop("head"))

    ends = placed.where(depth < F.col("level"))                  # these end at a burst node
    given = (heads.select(F.col("head").alias("path"), (F.col("depth") - 1).alias("to"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
             .unionByName(ends.select("path", depth.alias("to"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_leaves"),
                                      F.lit(0).cast("long").alias("saved_tokens"))))
    sums = stored(given.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "to")))
                  .groupBy(_prefix("k").alias("prefix"))
                  .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
                       F.sum("saved_tokens").alias("below")).join(burst, "prefix"), "trie-sums")
    kept = (sums.select(F.col("prefix").alias("path"), "depth", ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("own"))
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "depth")))
            .groupBy(_prefix("k").alias("prefix")).agg(F.sum("own").alias("own")))
    children = (heads.select(F.col("head").alias("path"), "depth").unionByName(burst.select(F.col("prefix").alias("path"), "depth"))
                .where("depth > 0").groupBy(_prefix("(depth - 1)").alias("prefix")).agg(F.count("*").alias("n_children")))
    up = sums.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    over = (sums.join(kept, "prefix").join(children, "prefix")
            .join(ends.select(F.col("path").alias("prefix"), "ends_sha256"), "prefix", "left")
            .withColumn("saved_tokens", F.col("below") + F.col("own"))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).withColumnRenamed("prefix", "path")
            .select("path", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
            .unionByName(heads.withColumnRenamed("head", "path").drop("parent_conv_id")))
    linked = (over.withColumn("above", F.when(F.col("depth") > 0, _prefix("(depth - 1)"))).join(up, "above", "left")
              .select(*[f.split()[0] for f in NODE.split(", ")]))
    return linked.unionByName(below)


def op12_burst_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
