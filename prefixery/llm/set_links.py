"""Links between the sets of groups: first against pivots, then block by block.

The Jaccard distance is a metric.  A round verifies every set of a group against one
of them, its pivot.  The group's sets are dealt to blocks, so a large group is many
tasks, and the pivot is sent to each block; nothing else is copied.  A set that links
with its pivot at distance d, while no unlinked set of the group is nearer to the
pivot than d + t (t: the distance of a link), has no link that is not known, and
leaves.  So a group of near copies ends after one round, whatever its size.  Rounds
go on, with an unlinked pivot, for groups that lose at least half of their sets.

What remains is dealt to pairs of blocks, each bounded in sets and in entries, one
pair of blocks to a call.  A group of b blocks moves b copies of its sets; these go in
waves, one after another, so that the copies on disk at a time do not grow with b.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

BLOCK = 1 << 20            # entries per block of a group (8 MB)
BLOCK_SETS = 1 << 9        # and sets
PAIRS = 8                  # calls per task, one in memory at a time
WAVE = 1 << 20             # entries of a wave per shuffle partition (8 MB)
ROUNDS = 4
SLACK = 1e-9

BROADCAST_ROWS = 500_000   # rows of some 40 bytes (20 MB) go to all tasks, more are joined by shuffle

_COLUMNS = ["doc_id", "node", "root", "n", "members", "label", "linked"]


def chosen_side(rows: DataFrame) -> DataFrame:
    """Rows of a stored table as the side of a join with the documents: broadcast
    while these are few, by shuffle beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


def common_counts(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Entries that each of the other sets (sorted, not empty) has in common with ``x``."""
    out = []
    while others:
        size = np.cumsum([len(y) for y in others])
        k = max(1, int(np.searchsorted(size, 1 << 20, "right")))
        part, others = others[:k], others[k:]
        flat = np.concatenate(part)
        at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        out.append(np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate([[0], size[:k - 1]])))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(entries, sets):
    return F.greatest(F.ceil(entries / BLOCK), F.ceil(sets / BLOCK_SETS)).cast("long")


def _measured(dealt: DataFrame, sets_of) -> DataFrame:
    """(root, node, pivot, both, np, n): each set against its group's pivot, which
    is the first row of its block."""
    def run(batches):
        key, pivot, own = None, None, None
        for b in batches:
            root, block, node, first = (np.asarray(b.column(c)) for c in ("root", "block", "node", "rank"))
            hashes = b.column("hashes")
            out = []
            edge = [0, *(np.flatnonzero((np.diff(root) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(root)]
            for x, y in zip(edge, edge[1:], strict=False):
                if x == y:
                    continue
                if (root[x], block[x]) != key or first[x] == 0:
                    key, pivot, own = (root[x], block[x]), np.frombuffer(hashes[x].as_buffer(), np.uint64), node[x]
                while x < y and first[x] == 0:                 # rows of one id may repeat the pivot
                    x += 1
                if x < y:
                    sets = [np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in range(x, y)]
                    size = np.array([len(s) for s in sets])
                    out.append((root[x:y], node[x:y], np.full(y - x, own), common_counts(pivot, sets), np.full(y - x, len(pivot)), size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 ["root", "node", "pivot", "both", "np", "n"])

    rows = sets_of(dealt, ["root", "block", "node", "rank"])
    return (rows.repartition("root", "block").sortWithinPartitions("root", "block", "rank", "node")
            .mapInArrow(run, "root long, node long, pivot long, both long, np long, n long"))


def _round(left: DataFrame, sets_of, percent: int, name: str, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: (links, what is left with its group's ``before`` sets)."""
    groups = stored(left.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("entries"),
                                             F.min(F.struct("linked", "node"))["node"].alias("pivot"))
                    .select("root", "sets", "pivot", _blocks(F.col("entries"), F.col("sets")).alias("blocks")), f"{name}-round")
    both = left.join(groups, "root")
    members = both.where("node <> pivot").select("doc_id", "node", "root", *extra, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
                                                 F.lit(1).alias("rank"))
    pivots = both.where("node = pivot").select("doc_id", "node", "root", *extra, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
                                               .alias("block"), F.lit(0).alias("rank"))
    dealt = stored(members.unionByName(pivots), f"{name}-dealt")
    share = F.col("both") / (F.col("np") + F.col("n") - F.col("both"))
    found = stored(_measured(dealt, sets_of).dropDuplicates(["root", "node"]).select(
        "root", "node", "pivot", (1 - share).alias("d"),
        (100 * F.col("both") >= percent * (F.col("np") + F.col("n") - F.col("both"))).alias("now")), f"{name}-measured")
    near = found.where("NOT now").groupBy("root").agg(F.min("d").alias("nearest"))
    stay = ~F.col("now") | (F.col("d") + (1 - percent / 100 + SLACK) >= F.col("nearest"))
    rest = (left.join(found, ["root", "node"]).join(near, "root").where(stay)
            .withColumn("label", F.when(F.col("now"), F.col("pivot")).otherwise(F.col("label")))
            .withColumn("linked", F.col("linked") | F.col("now")).select(*_COLUMNS, *extra))
    rest = stored(rest.join(groups.select("root", F.col("sets").alias("before")), "root"), f"{name}-rest")
    return found.where("now").select(F.col("node").alias("a"), F.col("pivot").alias("b")), rest


def group_links(chosen: DataFrame, sets_of: Callable, percent: int, found: Callable, name: str, rounds: int = ROUNDS,
                extra: list[str] = ()) -> DataFrame:
    """(a, b): verified links that connect all that links connect.

    ``chosen``: doc_id, node, root (group), n, members and the ``extra`` columns.
    ``sets_of(rows, columns)`` gives these columns of the rows and each one's sorted
    64-bit ``hashes``.
    ``found(node, sets, members, label, left, right)`` gives the rows (a, b) of a pair
    of blocks; sets with the same label are known to be connected."""
    left = chosen.select("doc_id", "node", "root", "n", "members", F.col("node").alias("label"), F.lit(False).alias("linked"), *extra)
    columns = [*_COLUMNS, *extra]
    links, blocks = [], []
    for _ in range(rounds):
        now, rest = _round(left, sets_of, percent, name, list(extra))
        links.append(now)
        sizes = stored(rest.groupBy("root").agg(F.count("*").alias("sets"), F.first("before").alias("before"),
                                                F.min("label").alias("low"), F.max("label").alias("high")), f"{name}-sizes")
        open_ = sizes.where("sets > 1 AND low < high")
        on = open_.where("2 * sets <= before")
        blocks.append(rest.join(open_.where("2 * sets > before").select("root"), "root", "left_semi").select(*columns))
        left = stored(rest.join(on.select("root"), "root", "left_semi").select(*columns), f"{name}-left")
        if not left.limit(1).count():
            break
    else:
        blocks.append(left)
    rest = blocks[0]
    for more in blocks[1:]:
        rest = rest.unionByName(more)
    rest = stored(rest, f"{name}-blocks")
    links.append(meetings(rest, sets_of, found, "a long, b long"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return stored(out.where("a <> b").distinct(), f"{name}-links")


def dealt_in_pairs(rows: DataFrame, parts: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """The sets, at every pair of blocks of their group; one ``part`` is one call.  A
    pair of blocks of a larger group is a part of its own (16 MB).  Of several
    ``waves``, each with its own pairs, one: those of blocks whose sum, with the
    group's offset, is ``wave`` modulo ``waves``."""
    first = F.pmod(F.lit(wave) - F.col("block") - F.pmod(F.xxhash64("root"), F.lit(waves)), F.lit(waves))
    rows = (rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("other", first).where("other < blocks")
            .withColumn("other", F.explode(F.sequence(F.col("other"), F.col("blocks") - 1, F.lit(waves).cast("long"))))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    part = F.when(F.col("blocks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(PAIRS * parts)))
    return rows.withColumn("part", part).select("part", "root", "i", "j", "block", "node", "members", "label", "hashes")


def meetings(chosen: DataFrame, sets_of: Callable, found: Callable, schema: str) -> DataFrame:
    """``found`` for every pair of blocks of every group (``label`` is optional)."""
    spark = chosen.sparkSession
    if "label" not in chosen.columns:
        chosen = chosen.withColumn("label", F.col("node"))
    groups = stored(chosen.groupBy("root").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks"), F.sum("n").alias("entries")), "set-blocks")
    total = groups.agg(F.coalesce(F.sum(F.expr("blocks * (blocks + 1) div 2")), F.lit(0)).alias("pairs"), F.count("*").alias("groups"),
                       F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
                       F.coalesce(F.sum(F.col("entries").cast("double") * F.col("blocks")), F.lit(0.0)).alias("moved")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waves = max(1, math.ceil(total["moved"] / (WAVE * partitions)))
    parts = max(partitions, (1 + int(total["entries"] // BLOCK + total["pairs"] - total["groups"]) // PAIRS) // waves)
    placed = stored(chosen.join(groups.drop("entries"), "root"), "set-placed")
    sets = sets_of(placed, ["root", "blocks", "node", "members", "label"])
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(t: pa.Table) -> pa.Table:
        root, i, j, block, node, members, label = (np.asarray(t.column(c).combine_chunks())
                                                   for c in ("root", "i", "j", "block", "node", "members", "label"))
        order = np.lexsort((node, j, i, root))
        same = (np.diff(root[order]) == 0) & (np.diff(i[order]) == 0) & (np.diff(j[order]) == 0)
        hashes, out = t.column("hashes"), []
        for at in np.split(order, np.flatnonzero(~same) + 1):
            at = at[np.concatenate([[True], np.diff(node[at]) != 0])]        # rows of one id may repeat a set
            if len(at) > 1:
                sets = [np.frombuffer(hashes[int(k)].as_buffer(), np.uint64) for k in at]
                own = block[at]
                left, right = np.flatnonzero(own == i[at[0]]), np.flatnonzero(own == j[at[0]])
                if len(left) and len(right):
                    out += found(node[at], sets, members[at], label[at], left, right)
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(names)})

    def met(wave: int) -> DataFrame:
        return dealt_in_pairs(sets, parts, wave, waves).repartition(parts, "part").groupBy("part").applyInArrow(meet, schema)

    if waves == 1:
        return met(0)
    sets = stored(sets, "set-hashes")
    out = [stored(met(k), "set-wave") for k in range(waves)]
    discard(sets)
    while len(out) > 1:                    # a plan of depth log(waves)
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) // 2 * 2:]
    return out[0]
