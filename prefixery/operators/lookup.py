"""Prefix lookup: single prefix, bulk completion of a request table, trending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_SUGGESTIONS, TRENDING_DISPLAY
from ..functions.normalize import is_blank, normalize, split_head


def lookup(index: DataFrame, prefix: str) -> DataFrame:
    """Ranked list of one (already normalised) prefix; empty when no node."""
    return index.where(F.col("prefix") == F.lit(prefix)).orderBy("rank")


def normalize_requests(requests: DataFrame, raw_col: str = "raw_prefix") -> DataFrame:
    """``prefix`` = normalised text; ``bypass`` marks null/blank requests."""
    return requests.withColumn("bypass", is_blank(raw_col)) \
        .withColumn("prefix", F.when(~F.col("bypass"), normalize(raw_col)))


def suggest_bulk(requests: DataFrame, nested: DataFrame, id_col: str = "request_id",
                 raw_col: str = "raw_prefix") -> DataFrame:
    """Batch form of the suggest endpoint.

    One row per (request, rank): ``(request_id, prefix, status, rank, query,
    score, match_head, match_tail)``; a request without suggestions keeps one
    row with null rank.  ``status`` is BYPASS (blank input, never looked up),
    FOUND or EMPTY (no such prefix).

    One left join of the requests to the nested index (one row per prefix):
    the requests are shuffled once, and a hot prefix is split by AQE's
    skew-join handling on the request side (the index row is replicated to
    the splits).  Blank requests carry a null prefix and never match.
    """
    req = normalize_requests(requests, raw_col)
    j = req.join(nested, "prefix", "left")
    status = (F.when(F.col("bypass"), F.lit("BYPASS"))
              .when(F.col("suggestions").isNull(), F.lit("EMPTY"))
              .otherwise(F.lit("FOUND")))
    j = j.select(id_col, "prefix", status.alias("status"),
                 F.posexplode_outer("suggestions").alias("_pos", "_s"))
    head, tail = split_head(F.col("_s.query"), F.col("prefix"))
    return j.select(id_col, "prefix", "status",
                    (F.col("_pos") + 1).alias("rank"),
                    F.col("_s.query").alias("query"), F.col("_s.score").alias("score"),
                    head.alias("match_head"), tail.alias("match_tail"))


def trending(cands: DataFrame, k: int = MAX_SUGGESTIONS) -> DataFrame:
    """Global top-k by blended score (equals the index list at the empty prefix)."""
    return (cands.orderBy(F.desc("score"), F.asc("query")).limit(k)
            .select("query", "score"))


def trending_display(trend: DataFrame, n: int = TRENDING_DISPLAY) -> DataFrame:
    return trend.orderBy(F.desc("score"), F.asc("query")).limit(n)


def trending_recent(catalog: DataFrame, k: int = MAX_SUGGESTIONS) -> DataFrame:
    """Top-k by recency alone (the documented variant)."""
    return (catalog.orderBy(F.desc("recent_score"), F.asc("query")).limit(k)
            .select("query", "recent_score"))
