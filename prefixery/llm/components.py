"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima joined back to the edges; nothing but the
count and a checksum of the edges reaches the driver.  The minima are stored
before the join, so that Spark can split the edges of a node with many
neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"))
                  .select("u", F.least("u", "m").alias("m")), "components-minima")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both)
    out = stored(both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "components-large")
    discard(edges, least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node u to the smaller v."""
    least = _minima(edges)
    joined = edges.join(least, "u")
    out = stored(joined.select("v", "m").union(joined.select("u", "m")).toDF("u", "v")
                 .where("u > v").distinct(), "components")
    discard(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges ``a``, ``b``; the root is the
    least node reachable.  An empty edge table gives an empty result."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u > v").distinct(), "components")
    state = None
    while True:
        now = _small(_large(now))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def one_node_per_id(out: DataFrame) -> DataFrame:
    """(doc_id, component_id, ...) in which a doc_id whose rows lie in different
    components connects these."""
    meets = stored(out.groupBy("doc_id").agg(F.min("component_id").alias("c0"), F.max("component_id").alias("c1"))
                   .where("c0 < c1").select("doc_id"), "components-meets")
    if not meets.limit(1).count():
        return out
    edges = (out.join(meets, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
             .union(out.join(meets, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("b"))
                    .select("doc_id", "b")))
    whole = stored(components(edges), "components-merged").withColumnRenamed("node", "component_id")
    return (out.join(whole, "component_id", "left")
            .withColumn("component_id", F.coalesce("root", "component_id")).select(*out.columns))
