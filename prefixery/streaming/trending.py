"""Continuous trending from the event stream with forward decay.

A streaming ``groupBy(query, day)`` keeps ``g = sum(2 ** ((ts - L) / h))`` with
the day's end as landmark ``L`` (Cormode et al., forward decay): a plain sum,
hence a partial/final aggregate with one state row per query and active day,
and exponents that stay within one day at any date.  The score as of ``T`` sums
``g * 2 ** (-(T - L) / h)`` over the days.  The state of days older than the
``watermark`` (64 half-lives by default: 2 ** -64 of their weight is left) goes, and
events that late with it; so the state is bounded by the queries of the days since.

There are two forms.  ``start_state`` keeps the aggregate in the query's own state
store and writes nothing; ``read_state`` reads it from the checkpoint
(Spark's ``statestore`` source) and takes the top k then.  ``start_trending`` writes
every update, for readers that cannot reach the checkpoint:
each micro-batch writes its updated rows (update mode) to a write-once attempt
folder and a commit record last, as the ingest does; readers take one committed
attempt per batch and the newest row per query and day.  ``compact_trending``
folds the batches into a base, removes them, and drops days that have decayed to
nothing (with their event counts).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HALF_LIFE_S, MAX_SUGGESTIONS
from ..operators.events import parse_events
from .ingest import remove_batches

DAY_MS = 86_400_000
ROW_SCHEMA = "query string, landmark_ms bigint, g double, events bigint, last_ms bigint"
KEYS = ", batch_id bigint, attempt string"


def _write(rows: DataFrame, out_path: str, batch_id: int) -> None:
    leaf = f"batch_id={batch_id}/attempt=a{uuid.uuid4().hex[:16]}"
    rows.select("query", "landmark_ms", "g", "events", "last_ms").write.mode("errorifexists").parquet(f"{out_path}/rows/{leaf}")
    (rows.sparkSession.createDataFrame([(True,)], "committed boolean")
     .write.mode("errorifexists").parquet(f"{out_path}/commits/{leaf}"))


WATERMARK = f"{int(64 * HALF_LIFE_S)} seconds"


def _aggregated(raw_stream: DataFrame, half_life_s: float, watermark: str | None) -> DataFrame:
    """(query, landmark_ms, g, events, last_ms) per query and day, as a stream."""
    landmark = ((F.floor(F.col("ts_ms") / DAY_MS) + 1) * DAY_MS).cast("bigint")
    parsed = parse_events(raw_stream).where(F.col("valid")).withColumn("landmark_ms", landmark)
    keys = ["query", "landmark_ms"]
    if watermark:
        parsed = parsed.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", watermark)
        keys.append(F.window("at", "1 day").alias("day"))          # lets old state go
    h = float(half_life_s) * 1000.0
    return parsed.groupBy(*keys).agg(
        F.sum(F.pow(F.lit(2.0), (F.col("ts_ms") - F.col("landmark_ms")).cast("double") / F.lit(h))).alias("g"),
        F.count(F.lit(1)).alias("events"), F.max("ts_ms").alias("last_ms"))


def _started(w, available_now: bool, interval_ms: int):
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{int(interval_ms)} milliseconds")
    return w.start()


def start_trending(raw_stream: DataFrame, out_path: str, checkpoint: str,
                   half_life_s: float = HALF_LIFE_S, available_now: bool = False,
                   interval_ms: int = 5_000, watermark: str | None = WATERMARK):
    agg = _aggregated(raw_stream, half_life_s, watermark)
    w = (agg.writeStream.outputMode("update")
         .foreachBatch(lambda batch, batch_id: _write(batch, out_path, batch_id))
         .option("checkpointLocation", checkpoint))
    return _started(w, available_now, interval_ms)


def start_state(raw_stream: DataFrame, checkpoint: str, half_life_s: float = HALF_LIFE_S, available_now: bool = False,
                interval_ms: int = 5_000, watermark: str = WATERMARK):
    """The aggregate in the state store alone; ``read_state`` reads it."""
    w = (_aggregated(raw_stream, half_life_s, watermark).writeStream.outputMode("update").format("noop")
         .option("checkpointLocation", checkpoint))
    return _started(w, available_now, interval_ms)


def read_state(spark: SparkSession, checkpoint: str, as_of_ms: int, half_life_s: float = HALF_LIFE_S,
               k: int = MAX_SUGGESTIONS) -> DataFrame:
    """The k queries with the highest score, from the state as of the last finished
    batch."""
    state = spark.read.format("statestore").load(checkpoint)
    h = float(half_life_s) * 1000.0
    now = F.col("value.sum") * F.pow(F.lit(2.0), (F.col("key.landmark_ms") - F.lit(float(as_of_ms))) / F.lit(h))
    return (state.select(F.col("key.query").alias("query"), now.alias("now")).groupBy("query").agg(F.sum("now").alias("score"))
            .orderBy(F.desc("score"), F.asc("query")).limit(k))


def _committed(spark: SparkSession, path: str, key: str) -> DataFrame:
    return (spark.read.schema(f"committed boolean, {key} bigint, attempt string").parquet(path)
            .groupBy(key).agg(F.min("attempt").alias("attempt")))


def _compacted(spark: SparkSession, out_path: str) -> int | None:
    """The last batch in the newest compacted base."""
    try:
        return _committed(spark, f"{out_path}/base_commits", "upto").agg(F.max("upto")).first()[0]
    except AnalysisException:                  # never compacted
        return None


def _latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest row per query and day: the last compacted base and the
    committed batches after it."""
    rows = spark.read.schema(ROW_SCHEMA + KEYS).parquet(f"{out_path}/rows").join(
        _committed(spark, f"{out_path}/commits", "batch_id"), ["batch_id", "attempt"], "left_semi")
    upto = _compacted(spark, out_path)
    rows = rows.drop("attempt")
    if upto is not None:
        base = spark.read.schema(ROW_SCHEMA).parquet(f"{out_path}/base/upto={upto}")
        rows = rows.where(F.col("batch_id") > upto).unionByName(base.withColumn("batch_id", F.lit(upto).cast("bigint")))
    return (rows.groupBy("query", "landmark_ms")
            .agg(F.max_by(F.struct("g", "events", "last_ms"), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
            .select("query", "landmark_ms", "s.*", "batch_id"))


def read_trending(spark: SparkSession, out_path: str, as_of_ms: int,
                  half_life_s: float = HALF_LIFE_S, k: int = MAX_SUGGESTIONS) -> DataFrame:
    """The k queries with the highest score as of an instant at or after their
    last events."""
    h = float(half_life_s) * 1000.0
    now = F.col("g") * F.pow(F.lit(2.0), (F.col("landmark_ms") - F.lit(float(as_of_ms))) / F.lit(h))
    return (_latest(spark, out_path).groupBy("query").agg(F.sum(now).alias("score"))
            .orderBy(F.desc("score"), F.asc("query")).limit(k))


def compact_trending(spark: SparkSession, out_path: str, as_of_ms: int, keep_half_lives: int = 64,
                     half_life_s: float = HALF_LIFE_S) -> None:
    """Fold the committed batches into a new base and remove them; days more than
    ``keep_half_lives`` back (2 ** -64 of their weight) go."""
    upto = spark.read.schema("committed boolean" + KEYS).parquet(f"{out_path}/commits").agg(F.max("batch_id")).first()[0]
    if upto is None or upto == _compacted(spark, out_path):
        return
    oldest = as_of_ms - int(keep_half_lives * half_life_s * 1000)
    rows = _latest(spark, out_path).where((F.col("landmark_ms") >= oldest) & (F.col("batch_id") <= upto)).drop("batch_id")
    rows.write.mode("errorifexists").parquet(f"{out_path}/base/upto={upto}")
    (spark.createDataFrame([(True,)], "committed boolean").write.mode("errorifexists")
     .parquet(f"{out_path}/base_commits/upto={upto}/attempt=a0"))
    for kind in ("commits", "rows"):
        remove_batches(spark, f"{out_path}/{kind}", upto - 1)      # the last stays, so that the folders do
