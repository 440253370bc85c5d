"""Search-event decoding, dead letters and per-batch folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_blank, normalize

EVENT_SCHEMA = "query string, ts bigint, event_id bigint"


def parse_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Decode JSON values permissively; ``valid`` is false for lines that do
    not parse, carry a null/blank query, or lack a numeric ``ts`` (recency
    is event time here, so an event needs one) -- the dead letters."""
    p = raw.withColumn("_e", F.from_json(F.col(value_col), EVENT_SCHEMA,
                                         {"mode": "PERMISSIVE"}))
    ok = ~is_blank(F.col("_e.query")) & F.col("_e.ts").isNotNull()
    return p.select(value_col,
                    F.when(ok, normalize(F.col("_e.query"))).alias("query"),
                    F.col("_e.ts").alias("ts_ms"), F.col("_e.event_id").alias("event_id"),
                    ok.alias("valid"))


def dead_letters(parsed: DataFrame, value_col: str = "value") -> DataFrame:
    return parsed.where(~F.col("valid")).select(value_col)


def fold_batch(parsed: DataFrame) -> DataFrame:
    """Per-batch delta map: ``(query, delta, max_ts_ms)`` for valid events."""
    return (parsed.where(F.col("valid"))
            .groupBy("query").agg(F.count(F.lit(1)).alias("delta"),
                                  F.max("ts_ms").alias("max_ts_ms")))


def to_event_records(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Serialize events as the producer does: key = query, value = {query, ts},
    with the event_id where the events carry one."""
    fields = [F.col("query"), F.col("ts_ms").alias("ts"), *[F.col(c) for c in ("event_id",) if c in events.columns]]
    return events.select(F.col("query").alias("key"), F.to_json(F.struct(*fields)).alias("value"), *keep)
