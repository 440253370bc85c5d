"""Workload metrics: write reduction, hit rate, latency percentiles, SLO gate,
keystroke debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (FLUSH_INTERVAL_MS, SLO_CHECKS, SLO_HIT_RATE, SLO_P95_MS, SLO_P99_MS)
from .quantiles import exact_quantiles, value_counts

PCTS = (0.5, 0.95, 0.99)


def write_reduction(events: DataFrame, key: str = "query", t_col: str = "ts_ms",
                    flush_ms: int = FLUSH_INTERVAL_MS) -> DataFrame:
    """Events received, rows upserted (distinct queries per flush window),
    flushes, and the two ratios.  Distinct-per-window is a two-level
    aggregate, so a hot window or query is combined map side."""
    per = (events.select(F.col(key), F.floor(F.col(t_col) / flush_ms).alias("flush_id"))
           .groupBy("flush_id", key).agg(F.count(F.lit(1)).alias("n")))
    tot = per.agg(F.sum("n").cast("bigint").alias("events_received"),
                  F.count(F.lit(1)).alias("rows_upserted"),
                  F.count_distinct("flush_id").alias("flushes"))
    return tot.select("*",
                      F.round(F.col("events_received") / F.col("rows_upserted"), 6)
                      .alias("events_per_row"),
                      F.round(F.col("events_received") / F.col("flushes"), 6)
                      .alias("events_per_flush"))


def hit_rate(log: DataFrame) -> DataFrame:
    """Share of timed requests served from cache (BYPASS is never timed)."""
    timed = log.where(F.col("outcome") != "BYPASS")
    return timed.agg(F.count(F.lit(1)).alias("requests"),
                     F.sum((F.col("outcome") == "HIT").cast("int")).cast("bigint").alias("hits"),
                     F.round(F.avg((F.col("outcome") == "HIT").cast("double")), 6)
                     .alias("hit_rate"))


def _pct(col: str, p: float, accuracy: int):
    return F.percentile_approx(col, p, accuracy)


def _quantile_table(timed: DataFrame, probs, exact: bool, accuracy: int, each: bool) -> DataFrame:
    """``(outcome, requests, p<..> ...)`` of all requests (outcome ALL) and,
    with ``each``, of every outcome; ALL is derived from the outcomes' value
    counts."""
    names = [f"p{int(round(p * 100))}" for p in probs]
    if exact:
        counts = value_counts(timed, "outcome", "latency_ms")
        whole = counts.groupBy("_v").agg(F.sum("_n").alias("_n")).select(F.lit("ALL").alias("_g"), "_v", "_n")
        q = exact_quantiles(counts.unionByName(whole) if each else whole, "outcome", probs)
        return q.select("outcome", F.col("n").alias("requests"),
                        *[F.col(f"q{k}").alias(nm) for k, nm in enumerate(names)])
    aggs = [F.count(F.lit(1)).alias("requests"),
            *[_pct("latency_ms", p, accuracy).alias(nm) for p, nm in zip(probs, names)]]
    whole = timed.agg(*aggs).select(F.lit("ALL").alias("outcome"), "requests", *names)
    return timed.groupBy("outcome").agg(*aggs).unionByName(whole) if each else whole


def latency_by_outcome(log: DataFrame, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """p50/p95/p99 latency per outcome plus an ``ALL`` row.

    ``exact`` takes ranks over value counts (``quantiles``), never gathering an
    outcome in one task; ``exact=False`` uses the fixed-size
    ``percentile_approx`` sketch."""
    timed = log.where(F.col("outcome") != "BYPASS").select("outcome", "latency_ms")
    t = _quantile_table(timed, PCTS, exact, accuracy, each=True)
    names = [f"p{int(round(p * 100))}" for p in PCTS]
    return t.select("outcome", F.col("requests").cast("bigint").alias("requests"),
                    *[F.round(n, 6).alias(n) for n in names])


def slo_gate(log: DataFrame, exact: bool = True) -> DataFrame:
    """Rows ``(metric, value, threshold, passed)`` for p95 < 25 ms,
    p99 < 60 ms, hit rate > 0.80 and checks > 0.99 (a check passes when a
    request got a response, i.e. a non-negative latency)."""
    timed = log.where(F.col("outcome") != "BYPASS")
    lat = _quantile_table(timed.select("outcome", "latency_ms"), (0.95, 0.99), exact, 10_000, each=False)
    rates = timed.agg(
        F.avg((F.col("outcome") == "HIT").cast("double")).alias("hit_rate"),
        F.avg((F.col("latency_ms") >= 0).cast("double")).alias("checks"))
    nul = F.lit(None).cast("double")
    m = (lat.select(F.col("p95").alias("p95_ms"), F.col("p99").alias("p99_ms"),
                    nul.alias("hit_rate"), nul.alias("checks"))
         .unionByName(rates.select(nul.alias("p95_ms"), nul.alias("p99_ms"), "hit_rate", "checks"))
         .agg(*[F.max(c).alias(c) for c in ("p95_ms", "p99_ms", "hit_rate", "checks")]))

    def row(name, col, threshold, passed):
        return F.struct(F.lit(name).alias("metric"), F.col(col).alias("value"),
                        F.lit(threshold).alias("threshold"), passed.alias("passed"))

    rows = F.array(
        row("p95_ms", "p95_ms", SLO_P95_MS, F.col("p95_ms") < SLO_P95_MS),
        row("p99_ms", "p99_ms", SLO_P99_MS, F.col("p99_ms") < SLO_P99_MS),
        row("hit_rate", "hit_rate", SLO_HIT_RATE, F.col("hit_rate") > SLO_HIT_RATE),
        row("checks", "checks", SLO_CHECKS, F.col("checks") > SLO_CHECKS))
    return m.select(F.inline(rows)).withColumn("value", F.round("value", 6))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Request counts per power-of-two latency bucket ``[2^b, 2^(b+1))`` ms,
    per outcome (bucket -1 holds latencies below 1 ms)."""
    timed = log.where(F.col("outcome") != "BYPASS")
    b = F.when(F.col("latency_ms") < 1, F.lit(-1)) \
        .otherwise(F.floor(F.log2("latency_ms"))).cast("int")
    return timed.groupBy("outcome", b.alias("bucket")).agg(F.count(F.lit(1)).alias("requests"))


def debounce(keys: DataFrame, gap_ms: int, session: str = "session", t_col: str = "ts_ms",
             order_col: str = "event_id") -> DataFrame:
    """Keep the values that settled: no later value of the same session within
    ``gap_ms``.  The next value is searched inside the row's gap-wide time
    bucket and, failing that, is the first value of the next bucket; windows
    are per (session, bucket), so one busy session is split over its buckets."""
    b = keys.withColumn("_b", F.floor(F.col(t_col) / gap_ms))
    w = Window.partitionBy(session, "_b").orderBy(t_col, order_col)
    b = b.withColumn("_next", F.lead(t_col).over(w))
    first_of = (b.groupBy(session, "_b").agg(F.min(t_col).alias("_bmin"))
                .select(session, (F.col("_b") - 1).alias("_b"), "_bmin"))
    j = b.join(first_of, [session, "_b"], "left")
    nxt = F.coalesce("_next", "_bmin")
    return (j.where(nxt.isNull() | (nxt - F.col(t_col) >= gap_ms))
            .drop("_b", "_next", "_bmin"))
