"""Exponentially decayed recency state without a mutable row store.

A query's state is ``(all_time_count, recent_score, last_ms)`` where
``recent_score`` is the decayed weight *as of* ``last_ms``.  States merge
associatively: ``T = max(at_i)``, ``score = sum(score_i * f**(T - at_i))``
with ``f = 0.5 ** (1 / half_life)``; this equals the original per-flush
recurrence ``s * f**(now - last) + delta``.

Built-in aggregates cannot carry the running maximum inside a weighted sum,
so events are first summed per (key, day) against a fixed landmark at the end
of the day (exponents stay within one day, 4 half-lives) in an ordinary
partial/final hash aggregate -- a hot query is combined map side.  The
second level holds one entry per active day of a key, a bounded list, which
is folded with a higher-order ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FLUSH_INTERVAL_MS, HALF_LIFE_S

DAY_MS = 86_400_000


def _pow_half(elapsed_ms, half_life_s):
    return F.pow(F.lit(0.5), elapsed_ms.cast("double") / F.lit(half_life_s * 1000.0))


def decayed_state(df: DataFrame, key: str = "query", t_col: str = "ts_ms",
                  weight: str | None = None, half_life_s: float = HALF_LIFE_S,
                  bucket_ms: int = DAY_MS) -> DataFrame:
    """``(key, all_time_count, recent_score, last_ms)`` from weighted timed rows:
    ``recent_score = sum(w * 0.5 ** ((T - t) / h))`` with ``T = max(t)`` per key."""
    w = F.col(weight) if weight else F.lit(1)
    landmark = (F.floor(F.col(t_col) / bucket_ms) + 1) * bucket_ms
    lvl1 = (df.select(F.col(key).alias("_k"), F.col(t_col).alias("_t"), w.alias("_w"),
                      landmark.alias("_l"))
            .groupBy("_k", "_l")
            .agg(F.sum("_w").alias("_n"), F.max("_t").alias("_tmax"),
                 F.sum(F.col("_w") * _pow_half(F.col("_l") - F.col("_t"), half_life_s))
                 .alias("_s")))
    return _fold_days(lvl1, half_life_s).withColumnRenamed("_k", key)


def _fold_days(lvl1: DataFrame, half_life_s: float) -> DataFrame:
    """Second level: per key, one list entry per landmark bucket."""
    g = (lvl1.groupBy("_k")
         .agg(F.sum("_n").alias("all_time_count"), F.max("_tmax").alias("last_ms"),
              F.collect_list(F.struct("_l", "_s")).alias("_days")))
    h = F.lit(half_life_s * 1000.0)
    score = F.aggregate(                 # sorted: the same sum in every run
        F.array_sort("_days"), F.lit(0.0),
        lambda acc, d: acc + d["_s"] * F.pow(F.lit(0.5),
                                              (F.col("last_ms") - d["_l"]).cast("double") / h))
    return g.select("_k", F.col("all_time_count").cast("bigint").alias("all_time_count"),
                    score.alias("recent_score"), "last_ms")


def flush_deltas(events: DataFrame, key: str = "query", t_col: str = "ts_ms",
                 flush_ms: int = FLUSH_INTERVAL_MS) -> DataFrame:
    """Per (flush window, query) deltas as the micro-batching writer would
    produce them: ``(flush_id, flush_ms, query, delta)``.  A flush happens at
    the latest event time of its window, shared by every query in it."""
    b = events.select(F.col(key).alias(key), F.col(t_col).alias("_t"),
                      F.floor(F.col(t_col) / flush_ms).alias("flush_id"))
    per_q = b.groupBy("flush_id", key).agg(F.count(F.lit(1)).alias("delta"),
                                           F.max("_t").alias("_qt"))
    # flush time = max over the window's queries: a second small aggregate
    # on the already reduced rows (one row per window), joined back.
    per_flush = per_q.groupBy("flush_id").agg(F.max("_qt").alias("flush_ms"))
    return per_q.join(per_flush, "flush_id").select("flush_id", "flush_ms", key, "delta")


def flush_parity_state(events: DataFrame, key: str = "query", t_col: str = "ts_ms",
                       flush_ms: int = FLUSH_INTERVAL_MS,
                       half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """State after replaying the events through timed flushes (recurrence at
    flush times, as the original writer does)."""
    d = flush_deltas(events, key, t_col, flush_ms)
    return decayed_state(d, key, "flush_ms", "delta", half_life_s)


def merge_states(states: DataFrame, key: str = "query", half_life_s: float = HALF_LIFE_S,
                 bucket_ms: int = DAY_MS) -> DataFrame:
    """Merge any number of state rows per key (base snapshot + deltas).

    Rows with a null ``last_ms`` (loaded but never touched) contribute their
    count only."""
    t = F.col("last_ms")
    landmark = F.when(t.isNotNull(), (F.floor(t / bucket_ms) + 1) * bucket_ms)
    lvl1 = (states.select(F.col(key).alias("_k"), "all_time_count", "recent_score", "last_ms",
                          landmark.alias("_l"))
            .groupBy("_k", "_l")
            .agg(F.sum("all_time_count").alias("_n"), F.max("last_ms").alias("_tmax"),
                 F.sum(F.coalesce(F.col("recent_score") *
                                  _pow_half(F.col("_l") - F.col("last_ms"), half_life_s),
                                  F.lit(0.0))).alias("_s")))
    out = _fold_days(lvl1.withColumn("_l", F.coalesce("_l", F.lit(0)))
                     .withColumn("_s", F.when(F.col("_tmax").isNull(), F.lit(0.0))
                                 .otherwise(F.col("_s"))), half_life_s)
    out = out.withColumn("recent_score", F.when(F.col("last_ms").isNull(), F.lit(0.0))
                         .otherwise(F.col("recent_score")))
    return out.withColumnRenamed("_k", key)


def decay_to(state: DataFrame, as_of_ms: int, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """Decay every row's recent_score to a common instant (build-time decay)."""
    el = F.greatest(F.lit(as_of_ms) - F.col("last_ms"), F.lit(0))
    return state.withColumn(
        "recent_score",
        F.when(F.col("last_ms").isNull(), F.col("recent_score"))
        .otherwise(F.col("recent_score") * _pow_half(el, half_life_s)))


def upsert(base: DataFrame, delta: DataFrame, key: str = "query",
           half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """One-shot keyed upsert of a delta state into the catalog (full outer
    join + coalesce): counts add, scores decay to the later time and add."""
    b = base.select(F.col(key), F.col("all_time_count").alias("b_n"),
                    F.col("recent_score").alias("b_s"), F.col("last_ms").alias("b_t"))
    d = delta.select(F.col(key), F.col("all_time_count").alias("d_n"),
                     F.col("recent_score").alias("d_s"), F.col("last_ms").alias("d_t"))
    j = b.join(d, key, "full_outer")
    t = F.greatest("b_t", "d_t")   # greatest skips nulls

    def part(s, at):
        return F.when(F.col(at).isNull(), F.lit(0.0)).otherwise(
            F.coalesce(F.col(s), F.lit(0.0)) * _pow_half(t - F.col(at), half_life_s))

    return j.select(key,
                    (F.coalesce("b_n", F.lit(0)) + F.coalesce("d_n", F.lit(0)))
                    .cast("bigint").alias("all_time_count"),
                    (part("b_s", "b_t") + part("d_s", "d_t")).alias("recent_score"),
                    t.alias("last_ms"))


def seed_from_log(log: DataFrame, term_col: str = "final_search_term",
                  time_col: str = "search_time", mode: str = "loader",
                  half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """Seed ``(query, all_time_count, recent_score, last_ms)`` from a raw log
    that carries a search time per row (one row = one search)."""
    from ..functions.normalize import normalize
    from ..functions.scoring import epoch_millis
    rows = (log.where(F.col(term_col).isNotNull())
            .select(normalize(term_col, mode).alias("query"),
                    epoch_millis(F.col(time_col).cast("timestamp_ntz")).alias("ts_ms"))
            .where(F.length("query") > 0))
    return decayed_state(rows, half_life_s=half_life_s)
