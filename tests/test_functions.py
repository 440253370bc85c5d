"""Hand-made cases: normalisation, fold, scoring, decay."""

import math


from prefixery.functions.normalize import is_blank, normalize, prefix_lengths, split_head
from prefixery.functions.scoring import blended_score
from prefixery.operators.fold import fold_query_log
from prefixery.operators.recency import decayed_state, merge_states, upsert


def test_unicode_strip(spark):
    df = spark.createDataFrame([(" Foo\t",), (" foo",), ("　x ",)], "q string")
    read = [r[0] for r in df.select(normalize("q")).collect()]
    loader = [r[0] for r in df.select(normalize("q", "loader")).collect()]
    assert read == ["foo", " foo", "x"]          # no-break space is not whitespace
    assert loader == [" foo\t", " foo", "　x"]   # ASCII spaces only


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("\t",), ("a",)], "q string")
    assert [r[0] for r in df.select(is_blank("q")).collect()] == [True, True, True, False]


def test_fold_case(spark):
    rows = [("Foo", 3), ("Foo", 3), (" foo ", 2), (None, 9), ("  ", 1)]
    log = spark.createDataFrame(rows, "final_search_term string, popularity bigint")
    out = {r["q"]: r["cnt"] for r in fold_query_log(log).collect()}
    assert out == {"foo": 5}


def test_fold_duplicates_invariant(spark):
    rows = [("a", 4), ("A", 2), ("b", 7)]
    log = spark.createDataFrame(rows, "final_search_term string, popularity bigint")
    once = sorted(fold_query_log(log).collect())
    twice = sorted(fold_query_log(log.unionByName(log).unionByName(log)).collect())
    assert once == twice


def test_score(spark):
    df = spark.createDataFrame([(0, 0.0), (5, 2.0)], "c bigint, r double")
    s = [r[0] for r in df.select(blended_score("c", "r")).collect()]
    assert s[0] == 0.0
    assert abs(s[1] - 3.791759) < 1e-6


def test_decay_two_deltas(spark):
    t0 = 1_700_000_000_000
    ev = spark.createDataFrame([("q", t0, 4), ("q", t0 + 21_600_000, 1)],
                               "query string, ts_ms bigint, w bigint")
    r = decayed_state(ev, weight="w").collect()[0]
    assert r["all_time_count"] == 5
    assert abs(r["recent_score"] - 3.0) < 1e-12
    assert r["last_ms"] == t0 + 21_600_000


def test_merge_equals_upsert_equals_recurrence(spark):
    import random
    rnd = random.Random(7)
    t0 = 1_700_000_000_000
    evs = sorted((rnd.choice("abc"), t0 + rnd.randrange(0, 10 * 86_400_000)) for _ in range(300))
    # reference recurrence: each event is its own flush
    f = 0.5 ** (1 / 21600.0)
    state = {}
    for q, t in sorted(evs, key=lambda x: x[1]):
        n, s, last = state.get(q, (0, 0.0, None))
        s = (s * f ** ((t - last) / 1000.0) if last is not None else 0.0) + 1
        state[q] = (n + 1, s, t)
    df = spark.createDataFrame(evs, "query string, ts_ms bigint")
    closed = {r["query"]: r for r in decayed_state(df).collect()}
    half = len(evs) // 2
    a = decayed_state(spark.createDataFrame(evs[:half], "query string, ts_ms bigint"))
    b = decayed_state(spark.createDataFrame(evs[half:], "query string, ts_ms bigint"))
    merged = {r["query"]: r for r in merge_states(a.unionByName(b)).collect()}
    ups = {r["query"]: r for r in upsert(a, b).collect()}
    for q, (n, s, last) in state.items():
        for got in (closed[q], merged[q], ups[q]):
            assert got["all_time_count"] == n
            assert got["last_ms"] == last
            assert math.isclose(got["recent_score"], s, rel_tol=1e-9)


def test_prefixes_and_split(spark):
    df = spark.createDataFrame([("iPhone", "iph")], "q string, p string")
    r = df.select(prefix_lengths("q").alias("ns"), *[c.alias(n) for c, n in
                                               zip(split_head("q", "p"), ("h", "t"))]).collect()[0]
    assert r["ns"] == [0, 1, 2, 3, 4, 5, 6]
    assert (r["h"], r["t"]) == ("iPh", "one")


def test_seed_from_log(spark):
    from datetime import datetime

    from prefixery.operators.recency import seed_from_log
    log = spark.createDataFrame([(" Foo", datetime(2024, 1, 1, 0, 0)), ("foo", datetime(2024, 1, 1, 6, 0)),
                                 (None, datetime(2024, 1, 1))],
                                "final_search_term string, search_time timestamp_ntz")
    r = seed_from_log(log).collect()
    assert len(r) == 1 and r[0]["query"] == "foo" and r[0]["all_time_count"] == 2
    assert abs(r[0]["recent_score"] - 1.5) < 1e-12


def test_offline_load_from_parquet_glob(spark, sf_small):
    from prefixery.plans import publish as pub
    from prefixery.session import scratch_path
    from prefixery.sources import catalog_io, tables
    raw = scratch_path(spark, "rawlog")
    tables.term_log(spark, sf_small).repartition(3).write.parquet(raw)
    log = pub.read_query_log(spark, raw + "/*.parquet")
    assert set(log.columns) == {"final_search_term", "popularity"}
    snap, csv = scratch_path(spark, "snap"), scratch_path(spark, "csv")
    summary = pub.load_catalog(spark, log, snap, top_n=100, csv_path=csv).collect()[0]
    assert summary["n_rows"] == 100
    back = catalog_io.read_folded_csv(spark, csv)
    top = sorted(fold_query_log(log).collect(), key=lambda r: (-r["cnt"], r["q"]))[:100]
    assert sorted(map(tuple, back.collect())) == sorted((r["q"], r["cnt"]) for r in top)
    assert summary["max_cnt"] == top[0]["cnt"] and summary["min_cnt"] == top[-1]["cnt"]


def test_parse_events_dead_letters(spark):
    from prefixery.operators.events import dead_letters, fold_batch, parse_events
    lines = ['{"query":" Foo ","ts":10}', '{"query":"foo","ts":20}', "garbage", '{"ts":5}',
             '{"query":"  ","ts":7}', '{"query":"bar"}', '{"query":"bar","ts":"x"}']
    raw = spark.createDataFrame([(v,) for v in lines], "value string")
    parsed = parse_events(raw)
    assert {r["query"]: (r["delta"], r["max_ts_ms"]) for r in fold_batch(parsed).collect()} == {"foo": (2, 20)}
    assert sorted(r["value"] for r in dead_letters(parsed).collect()) == sorted(lines[2:])


def test_flush_parity_shares_flush_time(spark):
    from prefixery.operators.recency import flush_deltas, flush_parity_state
    t0 = 1_700_000_000_000                      # a multiple of 5 s
    ev = spark.createDataFrame([("a", t0 + 100), ("b", t0 + 4_000), ("a", t0 + 21_600_000)],
                               "query string, ts_ms bigint")
    d = {(r["flush_id"], r["query"]): (r["flush_ms"], r["delta"]) for r in flush_deltas(ev).collect()}
    assert d[(t0 // 5000, "a")] == (t0 + 4_000, 1)      # flushed with b, at b's time
    assert d[(t0 // 5000, "b")] == (t0 + 4_000, 1)
    st = {r["query"]: r for r in flush_parity_state(ev).collect()}
    # a: 1 at flush t0+4s, 1 at t0+6h -> 1 * 0.5 ** ((6h - 4s) / 6h) + 1
    want = 0.5 ** ((21_600_000 - 4_000) / 21_600_000) + 1
    assert st["a"]["all_time_count"] == 2 and abs(st["a"]["recent_score"] - want) < 1e-12
    assert st["b"]["last_ms"] == t0 + 4_000
