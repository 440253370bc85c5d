"""Settled input values as session windows (batch or streaming).

A value settles when nothing follows it within ``gap``: it is the last
value of its session window.

As a stream it is two queries.  ``start_admission`` splits what arrives at the
watermark: values not newer than the newest event time of the batches before it, less
``delay``, are late and go to a side table; the others are admitted.  Each batch
writes an attempt folder and its commit record with the newest event time last.
``start_settling`` reads the admitted values, drops those that a repeated attempt
brings again, and emits a session's last value in append mode once the watermark has
passed the session's end, when its state goes.  ``close_sessions`` admits a marker
far enough in the future to close what is still open.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SCHEMA = "session bigint, event_id bigint, ts_ms bigint, value string"
BATCH_KEYS = ", batch_id bigint, attempt string"


def settled_values(keys: DataFrame, gap_ms: int, session: str = "session",
                   t_col: str = "ts_ms", id_col: str = "event_id",
                   watermark: str | None = None) -> DataFrame:
    ts = F.timestamp_millis(F.col(t_col))
    df = keys.withColumn("_ts", ts)
    if watermark:
        df = df.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark([session, id_col])
    gap = f"{int(gap_ms) * 1000 - 1} microseconds"       # windows that touch are merged; a value exactly a gap later is not
    last = F.max_by(F.struct(F.col(id_col).alias(id_col), F.col(t_col).alias(t_col),
                             F.col("value").alias("value")),
                    F.struct(F.col(t_col), F.col(id_col)))
    out = (df.groupBy(F.col(session), F.session_window("_ts", gap).alias("_w"))
           .agg(last.alias("_last")))
    return out.select(session, f"_last.{id_col}", f"_last.{t_col}", "_last.value")


def _newest_before(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """Newest event time of the batches before this one (a commit row per batch)."""
    try:
        c = spark.read.schema("newest_ms bigint" + BATCH_KEYS).parquet(f"{out}/commits")
        return c.where(F.col("batch_id") < batch_id).agg(F.max("newest_ms")).first()[0]
    except AnalysisException:                  # the first batch
        return None


def start_admission(keys: DataFrame, out: str, checkpoint: str, delay_ms: int, available_now: bool = False,
                    interval_ms: int = 1_000):
    """Split a stream of values (``KEY_SCHEMA``) into admitted and late ones."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_before(spark, out, batch_id)
        leaf = f"batch_id={batch_id}/attempt=a{uuid.uuid4().hex[:16]}"
        late = F.lit(False) if newest is None else F.col("ts_ms") <= newest - delay_ms
        batch = batch.persist()
        try:
            batch.where(~late).write.mode("errorifexists").parquet(f"{out}/admitted/{leaf}")
            batch.where(late).write.mode("errorifexists").parquet(f"{out}/late/{leaf}")
            (batch.agg(F.max("ts_ms").alias("newest_ms")).coalesce(1).write.mode("errorifexists")
             .parquet(f"{out}/commits/{leaf}"))
        finally:
            batch.unpersist()

    w = keys.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{int(interval_ms)} milliseconds")
    return w.start()


def start_settling(spark: SparkSession, out: str, checkpoint: str, gap_ms: int, delay_ms: int, available_now: bool = False,
                   interval_ms: int = 1_000):
    """Session windows over the admitted values, into ``<out>/settled``."""
    keys = (spark.readStream.schema(KEY_SCHEMA + BATCH_KEYS).parquet(f"{out}/admitted").select("session", "event_id", "ts_ms", "value"))
    w = (settled_values(keys, gap_ms, watermark=f"{int(delay_ms)} milliseconds").where("event_id IS NOT NULL")
         .writeStream.outputMode("append").format("parquet").option("path", f"{out}/settled").option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{int(interval_ms)} milliseconds")
    return w.start()


def close_sessions(spark: SparkSession, out: str, gap_ms: int, delay_ms: int) -> None:
    """Admit a marker that moves the watermark past every open session.  A feed that
    goes on after this has to be newer than the marker."""
    newest = spark.read.schema("newest_ms bigint" + BATCH_KEYS).parquet(f"{out}/commits").agg(F.max("newest_ms")).first()[0]
    if newest is not None:
        leaf = f"batch_id=-1/attempt=a{uuid.uuid4().hex[:16]}"
        (spark.createDataFrame([(None, None, newest + gap_ms + delay_ms + 1, None)], KEY_SCHEMA).coalesce(1)
         .write.mode("errorifexists").parquet(f"{out}/admitted/{leaf}"))


def read_settled(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(KEY_SCHEMA).parquet(f"{out}/settled")


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """Late values, of one attempt per committed batch."""
    one = (spark.read.schema("newest_ms bigint" + BATCH_KEYS).parquet(f"{out}/commits")
           .groupBy("batch_id").agg(F.min("attempt").alias("attempt")))
    late = spark.read.schema(KEY_SCHEMA + BATCH_KEYS).parquet(f"{out}/late")
    return late.join(one, ["batch_id", "attempt"], "left_semi").select("session", "event_id", "ts_ms", "value")
