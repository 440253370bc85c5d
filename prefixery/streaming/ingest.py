"""Streaming ingest: search events -> per-micro-batch decayed deltas.

Each micro-batch folds its valid events into ``(query, all_time_count,
recent_score, last_ms)`` and writes them, with its dead letters, to a fresh
write-once folder ``stream=<s>/batch_id=<n>/attempt=<a>``; a one-row commit
record for that attempt is written last, with what the batch's own jobs observed
(events, rows, dead letters, event times).  Readers take exactly one committed
attempt per batch, so a batch replayed after a failure (same events, same
folded contents -- nothing depends on the clock) is never counted twice,
and an attempt that died half-written is never read.  Together with the
checkpoint this is effectively-once.  Readers merge the base snapshot with
the deltas newer than what the snapshot absorbed; compaction writes a new
snapshot and records the absorbed batch ids.

Flush policy: ``trigger(processingTime=...)`` (5 s by default) bounds
staleness; Kafka's ``maxOffsetsPerTrigger`` bounds batch size;
``availableNow`` drains a backlog in bounded batches and stops.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import FLUSH_INTERVAL_MS, HALF_LIFE_S
from ..operators.events import parse_events
from ..operators.recency import decayed_state, merge_states
from ..sources import range_store as rs
from ..sources.catalog_io import CATALOG_SCHEMA, read_snapshot

STATE_SCHEMA = ("query string, all_time_count bigint, recent_score double, last_ms bigint")
KEYS = ", stream string, batch_id bigint, attempt string"
COMMIT_SCHEMA = ("committed boolean, events bigint, dead_letters bigint, rows bigint, oldest_ms bigint, newest_ms bigint")


def _observed(o: Observation) -> dict:
    """What an observation has seen: nothing, if its rows were known to be none and
    the plan left them out."""
    try:
        return o.get
    except Py4JJavaError:
        return {}


def _batch_writer(state_root: str, stream_id: str, half_life_s: float):
    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = "a" + uuid.uuid4().hex[:16]
        leaf = f"stream={stream_id}/batch_id={batch_id}/attempt={attempt}"
        batch = batch.persist()
        try:
            seen, made = Observation(), Observation()
            valid = F.col("valid")
            st = decayed_state(batch.where(valid).select("query", "ts_ms"), half_life_s=half_life_s)
            (st.observe(made, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
             .parquet(f"{state_root}/deltas/{leaf}"))
            watched = batch.observe(seen, F.count(F.when(valid, 1)).alias("events"), F.count(F.when(~valid, 1)).alias("dead_letters"),
                                    F.min(F.when(valid, F.col("ts_ms"))).alias("oldest_ms"),
                                    F.max(F.when(valid, F.col("ts_ms"))).alias("newest_ms"))
            (watched.where(~valid).select("value").write.mode("errorifexists")
             .parquet(f"{state_root}/dead_letters/{leaf}"))
            # commit record last: only now does this attempt become visible
            got = dict.fromkeys(("events", "dead_letters", "rows"), 0) | _observed(seen) | _observed(made)
            row = (True, *[got.get(c.split()[0]) for c in COMMIT_SCHEMA.split(", ")[1:]])
            (batch.sparkSession.createDataFrame([row], COMMIT_SCHEMA)
             .write.mode("errorifexists").parquet(f"{state_root}/commits/{leaf}"))
        finally:
            batch.unpersist()
    return write


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The folder's rows; none while no batch has written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _committed(spark: SparkSession, state_root: str) -> DataFrame:
    """One committed attempt per (stream, batch_id): a small table, one row
    per micro-batch."""
    c = _read(spark, "committed boolean" + KEYS, f"{state_root}/commits")
    return c.groupBy("stream", "batch_id").agg(F.min("attempt").alias("attempt"))


def deduplicated(parsed: DataFrame, within: str) -> DataFrame:
    """One record per event id; valid records without an id and dead letters
    pass as they are."""
    known = F.col("valid") & F.col("event_id").isNotNull()
    once = (parsed.where(known).withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", within)
            .dropDuplicatesWithinWatermark(["event_id"]).drop("_at"))
    return once.unionByName(parsed.where(~known))


def start_ingest(raw_stream: DataFrame, state_root: str, checkpoint: str,
                 stream_id: str = "s0", available_now: bool = False,
                 interval_ms: int = FLUSH_INTERVAL_MS, half_life_s: float = HALF_LIFE_S,
                 dedup_within: str | None = None):
    """Start the ingest query over a ``(key, value)`` stream; returns the
    StreamingQuery.  After a crash, restarting with the same checkpoint
    resumes from the last committed offsets (earliest when there are none).

    ``dedup_within`` (an interval, e.g. ``"2 days"``) drops events whose
    ``event_id`` came before within that event time.  Events older than the interval behind the newest are late and
    dropped, as the state that could tell them is."""
    parsed = parse_events(raw_stream)
    if dedup_within:
        parsed = deduplicated(parsed, dedup_within)
    w = (parsed.writeStream.foreachBatch(_batch_writer(state_root, stream_id, half_life_s))
         .option("checkpointLocation", checkpoint)
         .queryName(f"ingest_{stream_id}"))
    if available_now:
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=f"{int(interval_ms)} milliseconds")
    return w.start()


def read_base(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """A base catalog and the batches it has absorbed: a plain snapshot
    (none), or a compacted one with its manifest, which is written last."""
    try:
        rows = spark.read.schema("stream string, last_batch bigint").json(f"{path}/manifest").collect()
    except AnalysisException:
        return read_snapshot(spark, path), {}
    return read_snapshot(spark, f"{path}/data"), {r["stream"]: int(r["last_batch"]) for r in rows if r["stream"]}


def read_deltas(spark: SparkSession, state_root: str,
                absorbed: dict[str, int] | None = None) -> DataFrame:
    """Delta states newer than ``absorbed`` (stream id -> last absorbed batch)."""
    d = _read(spark, STATE_SCHEMA + KEYS, f"{state_root}/deltas")
    d = d.join(_committed(spark, state_root), ["stream", "batch_id", "attempt"], "left_semi")
    for sid, last in (absorbed or {}).items():
        d = d.where((F.col("stream") != sid) | (F.col("batch_id") > last))
    return d


def read_dead_letters(spark: SparkSession, state_root: str) -> DataFrame:
    d = _read(spark, "value string" + KEYS, f"{state_root}/dead_letters")
    return d.join(_committed(spark, state_root), ["stream", "batch_id", "attempt"], "left_semi")


def current_catalog(spark: SparkSession, state_root: str, base: DataFrame | None = None,
                    absorbed: dict[str, int] | None = None,
                    half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """Merge-on-read: base snapshot (optional) + unabsorbed deltas."""
    d = read_deltas(spark, state_root, absorbed).select(
        "query", "all_time_count", "recent_score", "last_ms")
    if base is not None:
        d = base.select("query", "all_time_count", "recent_score", "last_ms").unionByName(d)
    return merge_states(d, half_life_s=half_life_s)


def compact(spark: SparkSession, state_root: str, base_path: str | None, out_path: str,
            half_life_s: float = HALF_LIFE_S) -> dict[str, int]:
    """Write base + the deltas it lacks as a new snapshot; return the last
    absorbed batch per stream (also written next to it as its manifest)."""
    base, before = read_base(spark, base_path) if base_path else (None, {})
    d = read_deltas(spark, state_root, before)
    absorbed = {r["stream"]: int(r["last"]) for r in
                d.groupBy("stream").agg(F.max("batch_id").alias("last")).collect()}    # a row per stream
    # Only the batches counted above enter the snapshot; later ones stay deltas.
    upto = F.lit(False)
    for sid, last in absorbed.items():
        upto = upto | ((F.col("stream") == sid) & (F.col("batch_id") <= last))
    d = d.where(upto).select("query", "all_time_count", "recent_score", "last_ms")
    if base is not None:
        d = base.select("query", "all_time_count", "recent_score", "last_ms").unionByName(d)
    merged = merge_states(d, half_life_s=half_life_s)
    merged.write.mode("errorifexists").parquet(f"{out_path}/data")
    absorbed = before | absorbed
    spark.createDataFrame(list(absorbed.items()), "stream string, last_batch bigint") \
        .coalesce(1).write.mode("errorifexists").json(f"{out_path}/manifest")
    return absorbed


def create_base(spark: SparkSession, base_root: str, catalog: DataFrame, slots: int | None = None) -> int:
    """A base catalog in key ranges, for ``compact_ranges``."""
    return rs.create(spark, base_root, catalog.select("query", "all_time_count", "recent_score", "last_ms"), "query", slots)


def read_ranges(spark: SparkSession, base_root: str) -> tuple[DataFrame, dict[str, int]]:
    """The newest generation of a base in key ranges, and the batches it has absorbed."""
    gen = rs.generation(spark, base_root)
    try:
        rows = spark.read.schema("stream string, last_batch bigint").json(f"{base_root}/absorbed/gen={gen}").collect()
    except AnalysisException:                   # as created
        rows = []
    return rs.read(spark, base_root, CATALOG_SCHEMA, gen), {r["stream"]: int(r["last_batch"]) for r in rows if r["stream"]}


def compact_ranges(spark: SparkSession, state_root: str, base_root: str, half_life_s: float = HALF_LIFE_S,
                   split_rows: int = rs.SPLIT_ROWS) -> dict[str, int]:
    """Fold the deltas that the base lacks into the key ranges that they touch; the
    other ranges' files are carried into the next generation as they are.  Returns the
    last absorbed batch per stream."""
    _, before = read_ranges(spark, base_root)
    d = read_deltas(spark, state_root, before)
    last = {r["stream"]: int(r["last"]) for r in
            d.groupBy("stream").agg(F.max("batch_id").alias("last")).collect()}        # a row per stream
    upto = F.lit(False)
    for sid, batch in last.items():             # later batches stay deltas
        upto = upto | ((F.col("stream") == sid) & (F.col("batch_id") <= batch))
    changes = merge_states(d.where(upto).select("query", "all_time_count", "recent_score", "last_ms"), half_life_s=half_life_s)
    absorbed = before | last

    def record(gen: int) -> None:
        spark.createDataFrame(list(absorbed.items()), "stream string, last_batch bigint") \
            .coalesce(1).write.mode("errorifexists").json(f"{base_root}/absorbed/gen={gen}")

    rs.rewrite(spark, base_root, "query", CATALOG_SCHEMA, changes,
               lambda rows, new: merge_states(rows.unionByName(new), half_life_s=half_life_s), split_rows, record)
    return absorbed


def remove_batches(spark: SparkSession, folder: str, last: int) -> int:
    """Remove the folders ``batch_id=<n>`` with n up to ``last``; returns how many."""
    jvm, n = spark.sparkContext._jvm, 0
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path) if fs.exists(path) else ():
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.partition("=")[2]) <= last:
            n += fs.delete(status.getPath(), True)
    return n


def vacuum(spark: SparkSession, state_root: str, absorbed: dict[str, int]) -> int:
    """Remove the rows of batches that a compacted snapshot has absorbed (the last
    batch stays).  Their commit records, a row each, stay for ``ingest_metrics``.
    Only once every reader has moved to that snapshot."""
    return sum(remove_batches(spark, f"{state_root}/{kind}/stream={stream}", last - 1)
               for kind in ("deltas", "dead_letters") for stream, last in absorbed.items())


def ingest_metrics(spark: SparkSession, state_root: str) -> DataFrame:
    """Per stream and micro-batch, as its own jobs observed it: events, dead_letters,
    rows, oldest_ms, newest_ms.  Reads the commit records alone, and so counts
    batches whose rows are gone, too."""
    c = _read(spark, COMMIT_SCHEMA + KEYS, f"{state_root}/commits")
    one = F.min_by(F.struct(*[x.split()[0] for x in COMMIT_SCHEMA.split(", ")[1:]]), "attempt")
    return c.groupBy("stream", "batch_id").agg(one.alias("m")).select("stream", "batch_id", "m.*")


def attempts(spark: SparkSession, state_root: str) -> DataFrame:
    """(stream, batch_id, attempts): committed attempts per micro-batch."""
    c = _read(spark, "committed boolean" + KEYS, f"{state_root}/commits")
    return c.groupBy("stream", "batch_id").agg(F.count(F.lit(1)).alias("attempts"))


def forget_last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """Remove the checkpoint's note that its last batch is done, as if the writer had
    stopped just before it; the next start replays that batch.  Returns its number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
    if not done:
        return None
    for name in (str(max(done)), f".{max(done)}.crc"):
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{name}"), False)
    return max(done)


def write_reduction(spark: SparkSession, state_root: str) -> DataFrame:
    """Write reduction of the ingest as it ran: events folded, rows written
    (one per distinct query per micro-batch) and micro-batches (flushes)."""
    d = ingest_metrics(spark, state_root).where("events > 0")
    return d.agg(F.sum("events").alias("events_received"), F.sum("rows").alias("rows_upserted"),
                 F.count(F.lit(1)).alias("flushes")) \
        .select("*", F.round(F.col("events_received") / F.col("rows_upserted"), 6)
                .alias("events_per_row"),
                F.round(F.col("events_received") / F.col("flushes"), 6).alias("events_per_flush"))
