"""The operational commands end to end on sf0.001."""

from pyspark.sql import functions as F

from prefixery import cli
from prefixery.session import scratch_path
from prefixery.sources import events_io, tables


def test_load_ingest_publish_suggest_export(spark, sf_small):
    raw = scratch_path(spark, "cli-raw")
    tables.term_log(spark, sf_small).write.parquet(raw)
    base, state, root = (scratch_path(spark, n) for n in ("cli-base", "cli-state", "cli-root"))
    s = cli.main(["load", "--log", raw + "/*.parquet", "--out", base], spark)
    assert s["n_rows"] > 0
    feed = scratch_path(spark, "cli-feed")
    events_io.write_event_files(tables.search_events(spark, sf_small), feed)
    cli.main(["ingest", "--feed", feed, "--state", state, "--once"], spark)
    p1 = cli.main(["publish", "--root", root, "--base", base, "--published-ms", "1706659200000"], spark)
    p2 = cli.main(["publish", "--root", root, "--base", base, "--state", state,
                   "--published-ms", "1706659200000"], spark)
    assert (p1["generation"], p2["generation"]) == (1, 2)
    assert p1["max_event_ms"] is None and p2["staleness_ms"] >= 0
    req = scratch_path(spark, "cli-req")
    tables.requests(spark, sf_small).write.parquet(req)
    out = scratch_path(spark, "cli-out")
    cli.main(["suggest", "--root", root, "--requests", req, "--out", out], spark)
    ans = spark.read.parquet(out)
    assert ans.where(F.col("status") == "FOUND").count() > 0
    cache = scratch_path(spark, "cli-cache")
    cli.main(["export", "--root", root, "--out", cache], spark)
    keys = spark.read.parquet(cache).select("key").collect()
    assert all(k["key"].startswith("suggest:v2:") for k in keys)
    cli.main(["export", "--root", root, "--out", cache, "--nodes", "0,1"], spark)      # a smaller ring leaves no old shard
    shards = {r["shard"] for r in spark.read.parquet(cache + "/gen=2").select("shard").distinct().collect()}
    assert shards == {"node-0", "node-1"}
    total = lambda path: spark.read.parquet(path + "/data").agg(F.sum("all_time_count")).first()[0]
    want = spark.read.parquet(base).agg(F.sum("all_time_count")).first()[0] + tables.search_events(spark, sf_small).count()
    once, twice = scratch_path(spark, "cli-base2"), scratch_path(spark, "cli-base3")
    cli.main(["compact", "--state", state, "--base", base, "--out", once], spark)
    cli.main(["compact", "--state", state, "--base", once, "--out", twice, "--vacuum"], spark)
    assert total(once) == total(twice) == want
    p3 = cli.main(["publish", "--root", root, "--base", twice, "--state", state, "--published-ms", "1706659200000"], spark)
    assert p3["index_rows"] == p2["index_rows"] and p3["staleness_ms"] == p2["staleness_ms"]
    w = scratch_path(spark, "cli-w")
    cli.main(["weights", "--base", base, "--out", w], spark)
    assert spark.read.text(w).collect()[0][0].startswith('[{"p":')


def test_fold_refresh_lookup_scan_metrics(spark, sf_small):
    """The loop in key ranges gives what the full jobs give."""
    from prefixery.plans import incremental as inc
    from prefixery.plans import publish as pub
    from prefixery.streaming import ingest as ing
    base, state, ranges, idx, root, feed = (scratch_path(spark, n) for n in (
        "cli-base", "cli-state", "cli-ranges", "cli-idx", "cli-root", "cli-feed"))
    words = spark.createDataFrame([(f"{a}{b}{k}", 9 - k) for a in "abc" for b in "xy" for k in range(8)], "q string, cnt bigint")
    from prefixery.operators.fold import to_catalog
    from prefixery.sources import catalog_io
    catalog_io.write_snapshot(to_catalog(words), base)
    now = "1706659200000"
    for k, part in enumerate(([("ax1", 1_706_659_000_000)], [("bz", 1_706_659_100_000), ("bz", 1_706_659_100_001)])):
        events_io.write_event_files(spark.createDataFrame(part, "query string, ts_ms bigint"), feed, mode="append" if k else "overwrite")
        cli.main(["ingest", "--feed", feed, "--state", state, "--once"], spark)
        folded = cli.main(["fold", "--state", state, "--ranges", ranges, "--base", base, "--slots", "6", "--vacuum"], spark)
        assert folded["rewritten"] <= (6 if k == 0 else 2)
        fresh = cli.main(["refresh", "--root", idx, "--ranges", ranges, "--state", state, "--published-ms", now, "--slots", "6"], spark)
        assert fresh["generation"] == k + 1 and fresh["changed"] == (48 if k == 0 else 1)
    catalog, absorbed = ing.read_ranges(spark, ranges)
    pub.publish(spark, root, ing.current_catalog(spark, state, catalog, absorbed), int(now))
    want = {r["prefix"]: [(s["query"], round(s["score"], 9)) for s in r["suggestions"]] for r in pub.read_lists(spark, root).collect()}
    got = {r["prefix"]: [(s["query"], round(s["score"], 9)) for s in r["suggestions"]] for r in inc.read_lists(spark, idx).collect()}
    assert got == want and got[""][0][0] == "ax1" and got["bz"][0][0] == "bz"
    one = cli.main(["lookup", "--root", root, "--prefix", " AX "], spark)
    assert [q for q, _ in one["suggestions"]] == [q for q, _ in want["ax"]]
    asked, out = scratch_path(spark, "cli-prefixes"), scratch_path(spark, "cli-found")
    spark.createDataFrame([("ax",), ("bz",), ("none",), (None,)], "prefix string").write.parquet(asked)
    cli.main(["scan", "--ranges", ranges, "--prefixes", asked, "--out", out], spark)
    assert {r["prefix"]: r["count"] for r in spark.read.parquet(out).groupBy("prefix").count().collect()} == {"ax": 8, "bz": 1}
    m = cli.main(["metrics", "--state", state], spark)
    assert (m["events"], m["rows"], m["batches"], m["newest_ms"]) == (3, 2, 2, 1_706_659_100_001)
