"""Consistent-hash ring: placement of keys on cache nodes.

Each node sits at ``vnodes`` points ``hash60("<node>#<v>")`` of a ring over
[0, 2**60); a key belongs to the first point at or after its hash, wrapping
to the first point.  The ring (nodes x vnodes rows) turns into arcs
``(prev, pos]`` and the lookup is a bucketed range join (``range_join``) on
the top 12 bits of the 60-bit position: at most points + 4096 broadcast rows,
independent of the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CACHE_NODES, VNODES
from ..functions.hashing import hash60
from .range_join import high_bits, interval_lookup

RING_BITS = 60
BUCKET_SHIFT = RING_BITS - 12
RING_MAX = (1 << RING_BITS) - 1


def ring_points(spark: SparkSession, nodes=CACHE_NODES, vnodes: int = VNODES) -> DataFrame:
    """``(pos, node)``; on a position collision the larger node id wins."""
    nodes = list(nodes)
    if not nodes:
        return spark.createDataFrame([], "pos bigint, node int")
    ids = F.element_at(F.array(*[F.lit(n) for n in nodes]),
                       (F.floor(F.col("id") / vnodes) + 1).cast("int"))
    pts = (spark.range(len(nodes) * vnodes)
           .select(ids.alias("node"), (F.col("id") % vnodes).alias("v"))
           .select(hash60(F.concat(F.col("node").cast("string"), F.lit("#"),
                                   F.col("v").cast("string"))).alias("pos"), "node"))
    return pts.groupBy("pos").agg(F.max("node").alias("node"))


def ring_arcs(points: DataFrame) -> DataFrame:
    """``(lo, hi, node)`` half-open arcs covering [0, 2**60); the wrap arc is
    split in two.  ``points`` is configuration-sized (nodes x vnodes)."""
    o = Window.orderBy("pos")
    p = points.select("pos", "node",
                      F.lag("pos").over(o).alias("prev"),
                      F.first("node").over(o.rowsBetween(Window.unboundedPreceding,
                                                         Window.unboundedFollowing)).alias("first_node"),
                      F.max("pos").over(o.rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)).alias("last_pos"))
    inner = p.select(F.coalesce("prev", F.lit(-1)).cast("bigint").alias("lo"),
                     F.col("pos").alias("hi"), "node")
    wrap = (p.where(F.col("prev").isNull())
            .select(F.col("last_pos").alias("lo"), F.lit(RING_MAX).cast("bigint").alias("hi"),
                    F.col("first_node").alias("node"))
            .where(F.col("lo") < F.col("hi")))
    return inner.unionByName(wrap)


def assign(keys: DataFrame, key_col: str, points: DataFrame, out: str = "node") -> DataFrame:
    """Attach the owning node of ``key_col`` (null when the ring is empty)."""
    arcs = ring_arcs(points).withColumnRenamed("node", out)
    k = keys.withColumn("_h", hash60(key_col))
    return interval_lookup(k, "_h", arcs, "lo", "hi", high_bits(BUCKET_SHIFT)) \
        .drop("_h", "lo", "hi")


def share(assigned: DataFrame, node_col: str = "node") -> DataFrame:
    """``(node, keys, share)``; the per-node counts are a node-sized table."""
    per = assigned.groupBy(node_col).agg(F.count(F.lit(1)).alias("keys"))
    tot = F.sum("keys").over(Window.partitionBy(F.lit(1)))
    return per.select(node_col, "keys", F.round(F.col("keys") / tot, 6).alias("share"))


def remap(keys: DataFrame, key_col: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Owner before and after a membership change, in one pass (two broadcast
    lookups, no shuffle): ``(keys, moved, moved_share, survivor_keys,
    survivor_kept)``."""
    a = assign(assign(keys, key_col, before, "before"), key_col, after, "after")
    after_nodes = after.select("node").distinct()
    surv = a.join(F.broadcast(after_nodes.withColumnRenamed("node", "before")
                              .withColumn("_alive", F.lit(True))), "before", "left")
    moved = F.col("before") != F.col("after")
    return surv.agg(F.count(F.lit(1)).alias("keys"),
                    F.sum(moved.cast("int")).cast("bigint").alias("moved"),
                    F.round(F.avg(moved.cast("double")), 6).alias("moved_share"),
                    F.sum(F.col("_alive").isNotNull().cast("int")).cast("bigint")
                    .alias("survivor_keys"),
                    F.sum((F.col("_alive").isNotNull() & ~moved).cast("int")).cast("bigint")
                    .alias("survivor_kept"))
