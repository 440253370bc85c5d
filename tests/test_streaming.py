"""Streaming ingest: replay idempotence, stream == batch, compaction."""

import math

from pyspark.sql import functions as F

from prefixery.operators.events import parse_events
from prefixery.operators.recency import decayed_state
from prefixery.session import scratch_path
from prefixery.sources import events_io, tables
from prefixery.streaming import ingest as ing


def _rows(df):
    return {r["query"]: (r["all_time_count"], r["recent_score"], r["last_ms"]) for r in df.collect()}


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][2] == b[k][2]
        assert math.isclose(a[k][1], b[k][1], rel_tol=1e-9)


def test_replayed_batch_changes_nothing(spark, sf_small):
    root = scratch_path(spark, "replay")
    raw = tables.event_json(spark, sf_small)
    batch = parse_events(raw)
    write = ing._batch_writer(root, "s0", 21600.0)
    write(batch, 0)
    first = _rows(ing.current_catalog(spark, root))
    write(batch, 0)                          # same batch id again
    _close(first, _rows(ing.current_catalog(spark, root)))
    # an attempt that died before its commit record is invisible
    junk = spark.createDataFrame([("ghost", 99, 9.0, 1)], ing.STATE_SCHEMA)
    junk.write.parquet(f"{root}/deltas/stream=s0/batch_id=1/attempt=adead")
    _close(first, _rows(ing.current_catalog(spark, root)))
    dead = ing.read_dead_letters(spark, root).count()
    assert dead == tables.bad_event_lines(spark, sf_small).count() > 0


def test_stream_equals_batch_and_compaction(spark, sf_small):
    se = tables.search_events(spark, sf_small)
    feed = scratch_path(spark, "feed")
    events_io.write_event_files(se, feed)
    root = scratch_path(spark, "ingest")
    q = ing.start_ingest(events_io.read_event_stream(spark, feed, max_files_per_trigger=5),
                         root, root + "/_ck", available_now=True)
    q.awaitTermination()
    batches = ing.read_deltas(spark, root).select("batch_id").distinct().count()
    assert batches > 1
    batch_state = _rows(decayed_state(se))
    _close(_rows(ing.current_catalog(spark, root)), batch_state)
    wr = ing.write_reduction(spark, root).collect()[0]
    assert wr["events_received"] == se.count() and wr["flushes"] == batches
    assert wr["rows_upserted"] >= len(batch_state)
    snaps = [scratch_path(spark, "snap") for _ in range(2)]
    ing.compact(spark, root, None, snaps[0])
    again = ing.compact(spark, root, snaps[0], snaps[1])       # nothing new: nothing is counted twice
    for snap in snaps:
        base, absorbed = ing.read_base(spark, snap)
        assert absorbed == again
        _close(_rows(ing.current_catalog(spark, root, base, absorbed)), batch_state)
    assert ing.vacuum(spark, root, again) > 0
    _close(_rows(ing.current_catalog(spark, root, base, absorbed)), batch_state)


def test_trending_long_after_the_first_event(spark):
    from prefixery.streaming import trending as trd
    day, t0 = 86_400_000, 1_704_000_000_000
    rows = [("early", t0), ("late", t0 + 730 * day), ("late", t0 + 730 * day - 21_600_000), ("also", t0 + 730 * day - 5)]
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "trend")

    def deliver(part, mode):
        events_io.write_event_files(spark.createDataFrame(part, "query string, ts_ms bigint"), feed, mode=mode)
        trd.start_trending(events_io.read_event_stream(spark, feed, 1), out, out + "/_ck", available_now=True).awaitTermination()

    deliver(rows[:2], "overwrite")
    now = t0 + 730 * day
    trd.compact_trending(spark, out, now)
    deliver(rows[2:], "append")
    for _ in range(2):
        got = {r["query"]: r["score"] for r in trd.read_trending(spark, out, now).collect()}
        assert math.isclose(got["late"], 1.5, rel_tol=1e-9) and math.isclose(got["also"], 1.0, rel_tol=1e-6)
        assert got.get("early", 0.0) < 1e-300
        trd.compact_trending(spark, out, now)


def test_restart_resumes_from_checkpoint(spark, sf_small):
    """A second run with the same checkpoint only folds files added since."""
    se = tables.search_events(spark, sf_small)
    split = se.agg(F.expr("percentile_disc(0.5) within group (order by ts_ms)")).collect()[0][0]
    feed = scratch_path(spark, "feed2")
    events_io.write_event_files(se.where(F.col("ts_ms") <= split), feed)
    root = scratch_path(spark, "ingest2")
    run = lambda: ing.start_ingest(events_io.read_event_stream(spark, feed, 3),
                                   root, root + "/_ck", available_now=True).awaitTermination()
    run()
    first_batches = ing.read_deltas(spark, root).select("batch_id").distinct().count()
    events_io.write_event_files(se.where(F.col("ts_ms") > split), feed, mode="append")
    run()
    assert ing.read_deltas(spark, root).select("batch_id").distinct().count() > first_batches
    _close(_rows(ing.current_catalog(spark, root)), _rows(decayed_state(se)))


def test_export_round_trip_and_corrupt_entry(spark):
    from prefixery.operators import export as ex
    from prefixery.operators import prefix_index as px
    from prefixery.operators import ring as rg
    cands = spark.createDataFrame([("iphone", 9.0), ("iphone case", 7.0)], "query string, score double")
    nested = px.nested_index(px.build_index(cands))
    exp = ex.serving_export(nested, 4, rg.ring_points(spark))
    row = exp.where(F.col("prefix") == "iph").collect()[0]
    assert row["key"] == "suggest:v4:iph" and 60 <= row["ttl_s"] <= 75
    bad = spark.createDataFrame([("k", "{not json")], "key string, value string")
    back = ex.read_export(exp.select("key", "value").unionByName(bad))
    got = {r["key"]: [(s["query"], s["score"]) for s in r["suggestions"]] for r in back.collect()}
    assert got["suggest:v4:iph"] == [("iphone", 9.0), ("iphone case", 7.0)]
    assert got["k"] == []


def test_publish_generations_are_monotone(spark):
    from prefixery.plans import publish as pub
    root = scratch_path(spark, "gens")
    assert pub.current_generation(spark, root) == 0
    cat = spark.createDataFrame([("iphone", 5, 1.0, 1000), ("ipad", 2, 0.0, 500)],
                                "query string, all_time_count bigint, recent_score double, last_ms bigint")
    assert pub.publish(spark, root, cat, 4000) == 1
    assert pub.publish(spark, root, cat, 5000) == 2
    ptr = {r["generation"]: r for r in pub.pointers(spark, root).collect()}
    assert ptr[2]["staleness_ms"] == 4000 and ptr[1]["nodes"] == 9
    assert [r["query"] for r in pub.read_index(spark, root).where("prefix = 'i'").orderBy("rank").collect()] == ["iphone", "ipad"]


def test_feed_slot_is_written_by_several_tasks(spark):
    rows = [(f"q{i % 700}", 1_700_000_000_000 + i) for i in range(5000)] + [("late", 1_700_000_000_000 + 86_400_000), ("none", None)]
    events = spark.createDataFrame(rows, "query string, ts_ms bigint")
    feed = scratch_path(spark, "spread-feed")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        events_io.write_event_files(events, feed)
    finally:
        spark.conf.set(name, was)
    back = spark.read.schema(events_io.FEED_SCHEMA + ", slot bigint").json(feed)
    files = {r["slot"]: r["count"] for r in back.select("slot", F.input_file_name()).distinct().groupBy("slot").count().collect()}
    day = 1_700_000_000_000 // 86_400_000
    assert files.keys() == {day, day + 1, None} and files[day] > 2
    got = back.select("key", F.get_json_object("value", "$.query").alias("q"), F.get_json_object("value", "$.ts").cast("long").alias("t"), "slot")
    assert sorted(got.collect(), key=str) == sorted([(q, q, t, None if t is None else t // 86_400_000) for q, t in rows], key=str)
