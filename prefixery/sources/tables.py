"""Input views over the given parquet tables.

Each function returns a DataFrame in the shape the suggestion jobs expect
(raw query log, search events, request log, ...), derived from the driver's
tables so that every job's work grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..functions.scoring import epoch_millis
from ..operators.events import to_event_records
from ..session import scratch_path

# Token separator of the raw term log: one space or newline run.
TERM_SPLIT = "[ \n]+"
LOG_PIECE = 1 << 16        # rows of a term that one task writes together


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_written: dict[tuple, str] = {}


def _identity(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input tables' files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "|".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(path)))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored_path(spark: SparkSession, sf_dir: str, name: str, make=None) -> str:
    """Folder of a derived input.  It is written (by ``make``) the first time a session
    needs it, again when the input files have changed or the folder is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _identity(spark, sf_dir))
    if key not in _written or not _there(spark, _written[key]):
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _written[key] = path
    return _written[key]


def written_once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived input, written to the shared scratch folder once and read from there
    after that, as an upstream job would hand it over."""
    return spark.read.parquet(stored_path(spark, sf_dir, name, make))


def once(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """A folder that ``make(folder)`` fills, once per session and state of the input."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _identity(spark, sf_dir))
    if key not in _written:
        path = scratch_path(spark, name)
        make(path)
        _written[key] = path
    return _written[key]


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text")
    return docs.select(F.explode(F.split("text", TERM_SPLIT)).alias("final_search_term"))


def _raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _tokens(spark, sf_dir).groupBy("final_search_term").agg(F.count(F.lit(1)).alias("popularity"))
    # A token's row holds nothing but its term and the term's count, so the rows are
    # repeated from the counts and no token is shuffled.  A hot term's rows are dealt
    # in pieces.
    piece = F.explode(F.expr(f"sequence(0L, div(popularity - 1, {LOG_PIECE}))"))
    pieces = counts.select("final_search_term", "popularity", piece.alias("_piece")).repartition("final_search_term", "_piece")
    one = F.explode(F.expr(f"sequence(1L, least({LOG_PIECE}, popularity - {LOG_PIECE} * _piece))"))
    return pieces.select("final_search_term", "popularity", one.alias("_row")).drop("_row")


def term_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw query log ``(final_search_term, popularity)``, stored as Parquet files.

    One row per token of ``documents.text``; ``popularity`` is the global
    count of that exact token, constant across its rows (like a published
    query log that carries a global count per term)."""
    return spark.read.parquet(term_log_path(spark, sf_dir))


def term_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the raw query log's files."""
    return stored_path(spark, sf_dir, "term-log", lambda: _raw_log(spark, sf_dir))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search events ``(event_id, query, ts, ts_ms)``: an event searches the
    product named by ``part`` row ``props.k``."""
    ev = (read_table(spark, sf_dir, "events")
          .select("event_id", "ts",
                  F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), normalize("p_name").alias("query"))
    return (ev.join(part, "k")
            .select("event_id", "query", "ts", epoch_millis("ts").alias("ts_ms")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed prefixes ``(request_id, raw_prefix, ts_ms)``: the first
    ``event_id % 6`` characters of each searched query (length 0 = blank); every
    seventh request mistypes what follows and matches nothing."""
    se = search_events(spark, sf_dir)
    typed = F.expr("left(query, cast(event_id % 6 as int))")
    return se.select(F.col("event_id").alias("request_id"),
                     F.when(F.col("event_id") % 7 == 3, F.concat(typed, F.lit("~zq"))).otherwise(typed).alias("raw_prefix"),
                     "ts_ms")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served requests ``(request_id, ts_ms, outcome, latency_ms)``;
    ``error`` events are cache misses, every other event type a hit.  Every
    eleventh event comes with a blank request before it, which is a bypass and
    not timed."""
    ev = read_table(spark, sf_dir, "events")
    blank = ev.where(F.col("event_id") % 11 == 5).select(
        (-F.col("event_id") - 1).alias("request_id"), epoch_millis("ts").alias("ts_ms"),
        F.lit("BYPASS").alias("outcome"), F.lit(None).cast("double").alias("latency_ms"))
    return blank.unionByName(ev.select(F.col("event_id").alias("request_id"),
                     epoch_millis("ts").alias("ts_ms"),
                     F.when(F.col("event_type") == "error", F.lit("MISS"))
                     .otherwise(F.lit("HIT")).alias("outcome"),
                     F.col("value").alias("latency_ms")))


def keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input-box values ``(session, event_id, ts_ms, value)`` per user."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("session"), "event_id",
                     epoch_millis("ts").alias("ts_ms"),
                     F.col("event_type").alias("value"))


def bad_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed feed records ``(key, value)``, made from every 97th event and
    its two followers: the bare query, a blank query, no query."""
    se = search_events(spark, sf_dir).withColumn("k", F.col("event_id") % 97).where("k < 3")
    ts = F.col("ts_ms").cast("string")
    value = (F.when(F.col("k") == 0, F.col("query"))
             .when(F.col("k") == 1, F.concat(F.lit('{"query":"  ","ts":'), ts, F.lit("}")))
             .otherwise(F.concat(F.lit('{"ts":'), ts, F.lit("}"))))
    return se.select(F.lit(None).cast("string").alias("key"), value.alias("value"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialized event feed ``(key, value)`` as a producer would publish it,
    with malformed lines in between."""
    return to_event_records(search_events(spark, sf_dir)).unionByName(bad_event_lines(spark, sf_dir))


def talk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches ``(query, ts_ms)`` for the words of ``conversations``, which the
    catalog of ``documents`` mostly holds; the time follows from conversation
    and turn."""
    words = read_table(spark, sf_dir, "conversations").select(
        F.explode(F.split("text", TERM_SPLIT)).alias("word"), (F.lit(1706659200000) - (F.col("conv_id") % 500) * 600000
                                                              - F.col("turn") * 1000).cast("long").alias("ts_ms"))
    return words.select(F.lower(F.trim("word")).alias("query"), "ts_ms").where(F.length("query") > 0)


def typed_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests ``(request_id, prefix)``: the first characters of each turn's first
    word, as far as typed (3 to 8, by turn)."""
    first = F.lower(F.get(F.split("text", TERM_SPLIT), F.lit(0)))
    typed = F.expr("left(word, cast(3 + turn % 6 as int))")
    return (read_table(spark, sf_dir, "conversations")
            .select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("request_id"), "turn", first.alias("word"))
            .select("request_id", typed.alias("prefix")).where(F.length("prefix") > 0))
