"""Serving export of the index as keyed JSON, and the routing report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TTL_BASE_S, TTL_JITTER_S
from ..functions.hashing import storage_key, ttl_with_jitter
from ..functions.normalize import normalize
from .ring import assign

SUGGESTION_LIST = "array<struct<query:string,score:double>>"


def node_label(c) -> F.Column:
    return F.when(c.isNull(), F.lit("none")).otherwise(F.concat(F.lit("node-"), c.cast("string")))


def serving_export(nested: DataFrame, generation: int, points: DataFrame,
                   base_ttl: int = TTL_BASE_S, jitter: int = TTL_JITTER_S) -> DataFrame:
    """``(shard, prefix, key, value, ttl_s)``: one JSON list per prefix under
    its generation-versioned key, placed by the ring on its prefix."""
    e = nested.select("prefix",
                      storage_key(F.lit(generation), F.col("prefix")).alias("key"),
                      F.to_json("suggestions").alias("value"))
    e = e.withColumn("ttl_s", ttl_with_jitter("key", base_ttl, jitter))
    e = assign(e, "prefix", points, "node")
    return e.select(node_label(F.col("node")).alias("shard"), "prefix", "key", "value", "ttl_s")


def read_export(export: DataFrame) -> DataFrame:
    """Decode values; a corrupt entry reads as an empty list."""
    return export.withColumn(
        "suggestions",
        F.coalesce(F.from_json("value", SUGGESTION_LIST),
                   F.array().cast(SUGGESTION_LIST)))


def routing_report(requests: DataFrame, nested: DataFrame, generation: int,
                   points: DataFrame, raw_col: str = "raw_prefix") -> DataFrame:
    """Per request: normalised prefix, generation, key, owner node and whether
    the generation's lists (one row per prefix) hold it (HIT) or not (MISS).
    Read from storage, the lists leave a hot prefix's requests to AQE's split."""
    r = requests.select("request_id", normalize(raw_col).alias("prefix"))
    r = r.withColumn("key", storage_key(F.lit(generation), F.col("prefix")))
    r = assign(r, "prefix", points, "node")
    j = r.join(nested.select("prefix", F.lit(True).alias("_present")), "prefix", "left")
    return j.select("request_id", "prefix", F.lit(generation).alias("generation"), "key",
                    node_label(F.col("node")).alias("owner_node"),
                    F.when(F.col("_present"), F.lit("HIT")).otherwise(F.lit("MISS"))
                    .alias("status"))
