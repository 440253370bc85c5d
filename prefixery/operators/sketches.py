"""Sketches that are stored per period and merged over any span.

Latency percentiles: one KLL sketch per (day, outcome); a span's percentiles come from
the merged sketches, without the requests.  Frequent terms: one frequent-items sketch
per part of the log, combined; only the terms that it names are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize

KLL_K = 800                # rank error about 0.4 % for one quantile
RANK_ERROR = 0.02
DAY_MS = 86_400_000
MAX_ITEMS = 16_384
CANDIDATES = 256
ITEMS_ERROR = 3.5          # a count is off by at most this share of rows / MAX_ITEMS


def latency_sketches(log: DataFrame) -> DataFrame:
    """(day, outcome, sketch) of the timed requests."""
    timed = log.where(F.col("outcome") != "BYPASS")
    return (timed.groupBy(F.floor(F.col("ts_ms") / DAY_MS).cast("bigint").alias("day"), "outcome")
            .agg(F.kll_sketch_agg_double("latency_ms", F.lit(KLL_K)).alias("sketch")))


def span_percentiles(sketches: DataFrame, probs: tuple[float, ...] = (0.5, 0.95, 0.99),
                     first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """(outcome, requests, p<..> ...) of the days in the span, from their sketches."""
    if first_day is not None:
        sketches = sketches.where(F.col("day") >= first_day)
    if last_day is not None:
        sketches = sketches.where(F.col("day") <= last_day)
    merged = sketches.groupBy("outcome").agg(F.kll_merge_agg_double("sketch", F.lit(KLL_K)).alias("s"))
    return merged.select("outcome", F.kll_sketch_get_n_double("s").alias("requests"),
                         *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"p{int(round(p * 100))}") for p in probs])


def rank_errors(log: DataFrame, estimates: DataFrame, probs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per outcome, whether each estimate lies within ``RANK_ERROR`` of its rank:
    some rank of the value (ties have a range of ranks) is that near to p.
    ``estimates`` has a row per outcome."""
    timed = log.where(F.col("outcome") != "BYPASS").select("outcome", "latency_ms")
    both = timed.join(F.broadcast(estimates), "outcome")
    names = [f"p{int(round(p * 100))}" for p in probs]
    counted = both.groupBy("outcome", "requests").agg(
        F.count("*").alias("n"), *[F.avg((F.col("latency_ms") < F.col(c)).cast("double")).alias(f"{c}_lo") for c in names],
        *[F.avg((F.col("latency_ms") <= F.col(c)).cast("double")).alias(f"{c}_hi") for c in names])
    return counted.select("outcome", "requests", *[
        ((F.col(f"{c}_lo") <= p + RANK_ERROR) & (F.col(f"{c}_hi") >= p - RANK_ERROR)).alias(f"{c}_near")
        for c, p in zip(names, probs, strict=True)])


def top_terms(log: DataFrame, k: int, term_col: str = "final_search_term", max_items: int = MAX_ITEMS,
              candidates: int = CANDIDATES) -> DataFrame:
    """(q, cnt, certain): the k most frequent normalised terms of a raw log of one row
    per search.  ``certain``: the count is above what the sketch can have missed.  Fewer
    rows where the sketch names fewer terms (none of the others is that frequent)."""
    terms = log.where(F.col(term_col).isNotNull()).select(normalize(term_col, "loader").alias("q")).where(F.length("q") > 0)
    parts = terms.groupBy(F.spark_partition_id().alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(q, {max_items})").alias("state"), F.count("*").alias("n"))
    whole = parts.agg(F.expr(f"approx_top_k_combine(state, {max_items})").alias("state"), F.sum("n").alias("n"))
    named = (whole.select("n", F.explode(F.expr(f"approx_top_k_estimate(state, {candidates})")).alias("i"))
             .select("n", F.col("i.item").alias("q")))                              # at most ``candidates`` rows
    exact = terms.join(F.broadcast(named), "q").groupBy("q", "n").agg(F.count("*").alias("cnt"))
    return (exact.select("q", "cnt", (F.col("cnt") > F.col("n") * (ITEMS_ERROR / max_items)).alias("certain"))
            .orderBy(F.desc("cnt"), F.asc("q")).limit(k))
