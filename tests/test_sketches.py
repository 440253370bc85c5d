"""Sketches against exact counts; the debounce stream's late side."""

from pyspark.sql import functions as F

from prefixery.operators import sketches as sk
from prefixery.session import scratch_path
from prefixery.streaming import debounce as dbn


def test_span_of_days_and_rank_errors(spark):
    log = spark.range(4000).select(
        (F.col("id") * 100_000).alias("ts_ms"), F.when(F.col("id") % 9 == 0, "MISS").when(F.col("id") % 10 == 1, "BYPASS").otherwise("HIT")
        .alias("outcome"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("latency_ms"))
    sketches = sk.latency_sketches(log)
    assert sketches.select("day").distinct().count() == 5
    for first, last in ((None, None), (1, 2), (4, 4)):
        part = log.where((F.floor(F.col("ts_ms") / 86_400_000) >= (first or 0)) & (F.floor(F.col("ts_ms") / 86_400_000) <= (last or 99)))
        rows = sk.rank_errors(part, sk.span_percentiles(sketches, first_day=first, last_day=last)).collect()
        want = {r["outcome"]: r["count"] for r in part.where("outcome <> 'BYPASS'").groupBy("outcome").count().collect()}
        assert {r["outcome"]: r["requests"] for r in rows} == want
        assert all(r["p50_near"] and r["p95_near"] and r["p99_near"] for r in rows)
    wrong = sk.span_percentiles(sketches).withColumn("p50", F.col("p95"))
    assert not any(r["p50_near"] for r in sk.rank_errors(log, wrong).collect())


def test_top_terms_and_their_bound(spark):
    rows = [("Head",)] * 900 + [("head ",)] * 50 + [("next",)] * 400 + [(f"tail{k}",) for k in range(3000)] + [(None,), (" ",)]
    log = spark.createDataFrame(rows, "final_search_term string").repartition(5)
    got = [tuple(r) for r in sk.top_terms(log, 3, max_items=512, candidates=64).collect()]
    assert got[:2] == [("head", 950, True), ("next", 400, True)]
    assert all(not certain for _, _, certain in got[2:])  # below what the sketch can miss
    plenty = [tuple(r) for r in sk.top_terms(log, 3000).collect()]
    assert len(plenty) == sk.CANDIDATES and plenty[0] == ("head", 950, True)


def test_debounce_stream_replayed_batch_and_late_values(spark):
    """A batch whose write is repeated brings its values twice; they settle once."""
    feed, out, gap, delay = scratch_path(spark, "keys"), scratch_path(spark, "debounce"), 100, 1000

    def deliver(rows):
        spark.createDataFrame(rows, dbn.KEY_SCHEMA).write.mode("append").json(feed)
        raw = spark.readStream.schema(dbn.KEY_SCHEMA).json(feed)
        dbn.start_admission(raw, out, out + "/_a", delay, available_now=True).awaitTermination()

    def settle():
        dbn.start_settling(spark, out, out + "/_s", gap, delay, available_now=True).awaitTermination()

    deliver([(1, 1, 10_000, "a"), (1, 2, 10_050, "ab"), (2, 3, 10_000, "x")])
    settle()
    spark.read.schema(dbn.KEY_SCHEMA).parquet(f"{out}/admitted/batch_id=0").write.parquet(f"{out}/admitted/batch_id=0/attempt=again")
    deliver([(1, 4, 10_120, "abc"), (2, 5, 10_100, "y"), (1, 6, 9_000, "late"), (2, 7, 9_051, "in time")])
    settle()
    dbn.close_sessions(spark, out, gap, delay)
    settle()
    assert sorted(tuple(r)[1:] for r in dbn.read_settled(spark, out).collect()) == [
        (3, 10_000, "x"), (4, 10_120, "abc"), (5, 10_100, "y"), (7, 9_051, "in time")]
    assert [r["event_id"] for r in dbn.read_late(spark, out).collect()] == [6]
