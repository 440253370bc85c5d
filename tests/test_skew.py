"""Skewed inputs: one key holds a third of all rows; massive ties at a cut."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from prefixery.operators import lookup as lk
from prefixery.operators import prefix_index as px
from prefixery.operators.fold import fold_query_log
from prefixery.operators.recency import decayed_state, merge_states
from prefixery.operators.topn import top_n


def _skewed_events(n=9000, seed=11):
    rnd = random.Random(seed)
    t0 = 1_700_000_000_000
    out = []
    for i in range(n):
        q = "hot query" if i % 3 == 0 else f"q{rnd.randrange(200)}"
        out.append((i, q, t0 + rnd.randrange(0, 5 * 86_400_000)))
    return out


def test_decay_with_hot_key(spark):
    rows = _skewed_events()
    df = spark.createDataFrame(rows, "event_id bigint, query string, ts_ms bigint").repartition(8)
    got = {r["query"]: r for r in decayed_state(df).collect()}
    by = defaultdict(list)
    for _, q, t in rows:
        by[q].append(t)
    for q, ts in by.items():
        last = max(ts)
        want = sum(0.5 ** ((last - t) / 21_600_000) for t in ts)
        assert got[q]["all_time_count"] == len(ts)
        assert math.isclose(got[q]["recent_score"], want, rel_tol=1e-9)


def test_fold_with_hot_term(spark):
    rows = [("the", 3000)] * 3000 + [(f"w{i}", 1) for i in range(6000)] + [("The", 5)] * 5
    log = spark.createDataFrame(rows, "final_search_term string, popularity bigint").repartition(8)
    got = {r["q"]: r["cnt"] for r in fold_query_log(log).collect()}
    assert got["the"] == 3005 and len(got) == 6001


def test_top_n_all_ties(spark):
    rows = [(f"q{i:05d}", 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "q string, cnt bigint").repartition(8)
    got = sorted(r["q"] for r in top_n(df, 1500, [F.desc("cnt"), F.asc("q")]).collect())
    assert got == [f"q{i:05d}" for i in range(1500)]


def test_hot_prefix_bulk_lookup(spark):
    cands = spark.createDataFrame([(f"apple {i}", float(i)) for i in range(50)] +
                                  [(f"banana {i}", float(i)) for i in range(5)],
                                  "query string, score double")
    nested = px.nested_index(px.build_index(cands))
    reqs = [(i, "ap" if i % 3 else "b") for i in range(3000)]
    req = spark.createDataFrame(reqs, "request_id bigint, raw_prefix string").repartition(8)
    out = lk.suggest_bulk(req, nested)
    per = Counter(r["request_id"] for r in out.collect())
    assert all(per[i] == (10 if i % 3 else 5) for i in range(3000))


def test_merge_untouched_catalog_rows(spark):
    base = spark.createDataFrame([("a", 10, 0.0, None), ("b", 3, 0.0, None)],
                                 "query string, all_time_count bigint, recent_score double, last_ms bigint")
    delta = spark.createDataFrame([("b", 2, 1.5, 1000), ("c", 1, 1.0, 2000)],
                                  "query string, all_time_count bigint, recent_score double, last_ms bigint")
    got = {r["query"]: (r["all_time_count"], r["recent_score"], r["last_ms"])
           for r in merge_states(base.unionByName(delta)).collect()}
    assert got == {"a": (10, 0.0, None), "b": (5, 1.5, 1000), "c": (1, 1.0, 2000)}


def test_top_n_by_count_brute_force(spark):
    from prefixery.operators.topn import top_n_by_count
    rnd = random.Random(5)
    rows = [(f"q{i:05d}", rnd.choice([1, 1, 1, 2, 2, 3, 5, 8, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "q string, cnt bigint").repartition(4)
    key = lambda x: (x[1] is None, -(x[1] or 0), x[0])
    for n in (1, 10, 999, 1500, 2900, 3000, 5000):
        got = sorted((r["q"], r["cnt"]) for r in top_n_by_count(df, n, "cnt", "q").collect())
        assert got == sorted(sorted(rows, key=key)[:n]), n
        agg = df.groupBy("q").agg(F.max("cnt").alias("cnt"))     # costly input path
        got2 = sorted((r["q"], r["cnt"]) for r in top_n_by_count(agg, n, "cnt", "q").collect())
        assert got2 == got, n


def _splits_skew(spark, df):
    """Whether the plan that ran splits a skewed partition, with thresholds that
    a small table reaches."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = df().select("*")
        plan.collect()
        return "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_prefix_is_split(spark):
    from prefixery.operators import export as ex
    from prefixery.operators import ring as rg
    from prefixery.session import scratch_path
    cands = spark.createDataFrame([(f"{c}pple {i}", float(i)) for c in "abcdefgh" for i in range(20)],
                                  "query string, score double")
    lists, reqs = scratch_path(spark, "lists"), scratch_path(spark, "requests")
    px.nested_index(px.build_index(cands)).write.parquet(lists)
    spark.createDataFrame([(i, "ap" if i % 3 else "bcdefgh"[i % 7]) for i in range(20000)],
                          "request_id bigint, raw_prefix string").repartition(12).write.parquet(reqs)
    nested, req = spark.read.parquet(lists), spark.read.parquet(reqs)
    assert _splits_skew(spark, lambda: lk.suggest_bulk(req, nested))
    assert _splits_skew(spark, lambda: ex.routing_report(req, nested, 1, rg.ring_points(spark)))
