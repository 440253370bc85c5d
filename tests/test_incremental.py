"""Range stores, incremental rebuilds, bucketed lists, the roll-up and bulk prefix scans."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from prefixery.config import IndexParams
from prefixery.operators import lookup as lk
from prefixery.operators import prefix_index as px
from prefixery.operators import rollup as ru
from prefixery.plans import incremental as inc
from prefixery.plans import publish as pub
from prefixery.session import scratch_path
from prefixery.sources import range_store as rs
from prefixery.streaming import ingest as ing

CANDS = "query string, score double"


def invented(seed, n):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(n)})


def brute_lists(scores, k):
    out = {}
    for q in scores:
        for n in range(len(q) + 1):
            out.setdefault(q[:n], []).append(q)
    return {p: [(q, scores[q]) for q in sorted(qs, key=lambda q: (-scores[q], q))[:k]] for p, qs in out.items()}


def lists_of(df):
    return {r["prefix"]: [(s["query"], s["score"]) for s in r["suggestions"]] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 3, 64, 65, 300])
def test_router_equals_bisection(spark, n):
    keys = invented(n, 4 * n)
    bounds = ["", *random.Random(1).sample(keys, min(len(keys), n) - 1)]
    slots = [{"low": b} for b in sorted(bounds)]
    lows = [s["low"] for s in slots]
    df = spark.createDataFrame([(k,) for k in [*keys, "", "zz", "\U0001F600", "a\"\\\n"]], "k string")
    for r in df.select("k", rs.router(slots)(F.col("k")).alias("s"), rs.last_slot(slots)(F.col("k")).alias("e")).collect():
        assert r["s"] == bisect.bisect_right(lows, r["k"]) - 1
        assert r["e"] == max(i for i, b in enumerate(lows) if b <= r["k"] or b.startswith(r["k"]))


def test_rewrite_keeps_untouched_files_and_splits_grown_slots(spark):
    root, rows = scratch_path(spark, "store"), [(f"k{k:04d}", 1) for k in range(400)]
    rs.create(spark, root, spark.createDataFrame(rows, "k string, v int"), "k", 5)
    before = rs.manifest(spark, root)
    assert len(before) == 5 and sum(r["n_rows"] for r in before) == 400
    files = {r["path"]: sorted(f.rsplit("/", 1)[-1] for f in spark.read.parquet(f"{root}/{r['path']}").inputFiles()) for r in before}
    changes = spark.createDataFrame([(f"k{k:04d}", 2) for k in (3, 5)] + [(f"k0010x{k:03d}", 3) for k in range(150)], "k string, v int")

    def merge(old, new):
        return old.join(new.select("k"), "k", "left_anti").unionByName(new)

    assert rs.rewrite(spark, root, "k", "k string, v int", changes, merge, split_rows=100) == 2
    after = rs.manifest(spark, root)
    same = {r["path"] for r in after} & set(files)
    assert len(same) == 4 and len(after) == 4 + 3
    for p in same:
        assert files[p] == sorted(f.rsplit("/", 1)[-1] for f in spark.read.parquet(f"{root}/{p}").inputFiles())
    want = {**dict(rows), **{r["k"]: r["v"] for r in changes.collect()}}
    assert {r["k"]: r["v"] for r in rs.read(spark, root, "k string, v int").collect()} == want
    assert rs.rewrite(spark, root, "k", "k string, v int", changes.where("1 = 0"), merge) == 2
    assert {r["k"]: r["v"] for r in rs.read(spark, root, "k string, v int", 1).collect()} == dict(rows)     # the older one is whole
    assert rs.vacuum(spark, root) == 2
    assert {r["k"]: r["v"] for r in rs.read(spark, root, "k string, v int").collect()} == want


def test_compaction_rewrites_only_touched_ranges(spark):
    schema = "query string, all_time_count bigint, recent_score double, last_ms bigint"
    root, base = scratch_path(spark, "state"), scratch_path(spark, "base")
    ing.create_base(spark, base, spark.createDataFrame([(q, 5, 0.0, None) for q in invented(3, 300)], schema), 6)
    first = {r["path"] for r in rs.manifest(spark, base)}
    raw = spark.createDataFrame([('{"query":"aab","ts":1000}',), ('{"query":"aab","ts":1000}',), ("junk",)], "value string")
    from prefixery.operators.events import parse_events
    write = ing._batch_writer(root, "s0", 21600.0)
    write(parse_events(raw), 0)
    write(parse_events(raw), 0)                                       # replayed
    assert ing.compact_ranges(spark, root, base) == {"s0": 0}
    second = {r["path"] for r in rs.manifest(spark, base)}
    assert len(first - second) == 1 and len(second - first) == 1
    catalog, absorbed = ing.read_ranges(spark, base)
    assert absorbed == {"s0": 0}
    got = {r["query"]: (r["all_time_count"], r["recent_score"]) for r in ing.current_catalog(spark, root, catalog, absorbed).collect()}
    assert got["aab"] == (7 if "aab" in invented(3, 300) else 2, pytest.approx(2.0)) and sum(n for n, _ in got.values()) == 5 * len(invented(3, 300)) + 2
    assert ing.compact_ranges(spark, root, base) == {"s0": 0}         # nothing new, nothing counted twice
    assert {r["path"] for r in rs.manifest(spark, base)} == second
    m = ing.ingest_metrics(spark, root).collect()
    assert [(r["events"], r["dead_letters"], r["rows"], r["oldest_ms"], r["newest_ms"]) for r in m] == [(2, 1, 1, 1000, 1000)]


def test_metrics_of_batches_without_events(spark):
    from prefixery.operators.events import parse_events
    root = scratch_path(spark, "state")
    write = ing._batch_writer(root, "s0", 21600.0)
    write(parse_events(spark.createDataFrame([("junk",), (None,)], "value string")), 0)
    write(parse_events(spark.createDataFrame([], "value string")), 1)
    got = {r["batch_id"]: (r["events"], r["dead_letters"], r["rows"], r["newest_ms"]) for r in ing.ingest_metrics(spark, root).collect()}
    assert got == {0: (0, 2, 0, None), 1: (0, 0, 0, None)}
    assert ing.current_catalog(spark, root).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_incremental_index_equals_full_rebuild(spark, k):
    """Scores rise, fall, tie, come and go, over several generations."""
    r, params, root = random.Random(k), IndexParams(k=k), scratch_path(spark, "ranges")
    scores = {q: float(r.randrange(12)) for q in invented(k, 120)}
    inc.create_index(spark, root, spark.createDataFrame(list(scores.items()), CANDS), params, 4)
    assert lists_of(inc.read_lists(spark, root)) == brute_lists(scores, k)
    for turn in range(3):
        new = dict(scores)
        for q in r.sample(sorted(new), 12):
            if turn != 1 and r.random() < 0.4:
                del new[q]
            else:
                new[q] = float(r.randrange(12))
        new.update({q: float(r.randrange(12)) for q in invented(90 + turn, 6)})
        new.pop(max(new, key=new.get))
        changes = inc.candidate_changes(spark, root, spark.createDataFrame(list(new.items()), CANDS))
        assert {x["query"]: x["score"] for x in changes.collect()} == {
            q: new.get(q) for q in set(new) | set(scores) if new.get(q) != scores.get(q)}
        inc.update_index(spark, root, changes, params)
        scores = new
        assert lists_of(inc.read_lists(spark, root)) == brute_lists(scores, k)


def test_incremental_index_carries_untouched_slots(spark):
    root = scratch_path(spark, "ranges")
    rows = [(f"{a}{b}{k}", float(k)) for a in "abcdefgh" for b in "xyz" for k in range(9)]
    inc.create_index(spark, root, spark.createDataFrame(rows, CANDS), IndexParams(), 8)
    before = {r["path"] for r in rs.manifest(spark, f"{root}/lists")}
    inc.update_index(spark, root, spark.createDataFrame([("bx3", 99.0)], CANDS))
    after = {r["path"] for r in rs.manifest(spark, f"{root}/lists")}
    assert 1 <= len(after - before) <= 3 and len(before & after) >= 5
    assert lists_of(inc.read_lists(spark, root))[""][0] == ("bx3", 99.0)


def test_prefix_scan_equals_brute_force(spark):
    queries = invented(7, 400)
    root = scratch_path(spark, "scan")
    rs.create(spark, root, spark.createDataFrame([(q, len(q)) for q in queries], "query string, n int"), "query", 7)
    prefixes = ["", "a", "ab", "abc", "é", "éa", "zz", queries[17], queries[200] + "x", "cccccccccccc", "\U0001F600"]
    df = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    got = sorted((r["prefix"], r["query"], r["n"]) for r in rs.scan_prefixes(spark, root, "query", "query string, n int", df).collect())
    assert got == sorted((p, q, len(q)) for p in prefixes for q in queries if q.startswith(p))
    plan = rs.scan_prefixes(spark, root, "query", "query string, n int", df.where("prefix = 'abc'"))
    assert len(plan.inputFiles()) <= 3                                # the slots of one short range, and the request tables
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("cuts, longest", [(ru.CUTS, None), (tuple(range(9, -1, -1)), None), ((3, 0), 4), ((0,), 2)])
def test_rollup_equals_explode(spark, cuts, longest):
    r = random.Random(len(cuts))
    cands = spark.createDataFrame([(q, float(r.randrange(6))) for q in invented(len(cuts), 500)], CANDS)
    got = {tuple(x) for x in ru.rollup_index(cands, 3, longest, cuts).collect()}
    assert got == {tuple(x) for x in px.build_index(cands, 3, longest).collect()}
    with pytest.raises(ValueError):
        ru.rollup_index(cands, 3, None, (3, 1))


def test_bucketed_lists_are_joined_without_moving_them(spark):
    root = scratch_path(spark, "buckets")
    cat = spark.createDataFrame([(q, len(q), 0.0, 5) for q in invented(2, 200)],
                                "query string, all_time_count bigint, recent_score double, last_ms bigint")
    gen = pub.publish(spark, root, cat, 10, partitions=4)
    requests = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "ab", "zz", None, " "] * 5)], "request_id long, raw_prefix string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            answers = lk.suggest_bulk(requests, pub.read_lists(spark, root, gen))
            plan = answers._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Bucketed: true")
            assert answers.where("status = 'FOUND'").count() > 0
            spark.sql(f"DROP TABLE {pub._table_name(root, gen)}")      # another session names it again
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    index = px.build_index(px.candidates(cat))
    for p in ("", "a", "ab", "nothing"):
        got = [(r["rank"], r["query"], r["score"]) for r in pub.lookup_published(spark, root, p).orderBy("rank").collect()]
        assert got == [(r["rank"], r["query"], r["score"]) for r in lk.lookup(index, p).collect()]
    files = pub.read_lists(spark, root).where("prefix = 'ab'").select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and len(pub.read_lists(spark, root).inputFiles()) == 4


def test_derived_inputs_follow_their_tables(spark, tmp_path):
    from prefixery.sources import tables
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))
    for _ in range(2):
        assert tables.written_once(spark, str(tmp_path), "three", make).count() == 3
    assert len(made) == 1
    spark.range(9).write.parquet(str(tmp_path / "events.parquet"))    # the input changes
    tables.written_once(spark, str(tmp_path), "three", make)
    assert len(made) == 2
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.stored_path(spark, str(tmp_path), "three", make))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    assert tables.written_once(spark, str(tmp_path), "three", make).count() == 3 and len(made) == 3


def test_raw_log_repeats_counts_and_shuffles_no_token(spark, tmp_path, monkeypatch):
    from collections import Counter

    from prefixery.sources import tables
    monkeypatch.setattr(tables, "LOG_PIECE", 3)
    texts = ["a b a\na", "b  a é", "", None, " a", "a a a"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = [w for t in texts if t is not None for w in re.split("[ \n]+", t)]
    counts = Counter(tokens)
    log = tables._raw_log(spark, str(tmp_path))
    assert Counter((r["final_search_term"], r["popularity"]) for r in log.collect()) == Counter((w, counts[w]) for w in tokens)
    assert max(counts.values()) > 2 * tables.LOG_PIECE
    assert "Join" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_few_prefixes_move_no_row(spark):
    words = invented(12, 900)
    root = scratch_path(spark, "scan-broadcast")
    rs.create(spark, root, spark.createDataFrame([(w, float(len(w))) for w in words], CANDS), "query", 5)
    some = sorted({w[:k] for w in words[::9] for k in (1, 2, 3)}) + ["zz"]
    prefixes = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in some], 3), "prefix string")   # of unknown size
    found = rs.scan_prefixes(spark, root, "query", CANDS, prefixes)
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["prefix"], r["query"], r["score"]) for r in found.collect()) == sorted(
        (p, w, float(len(w))) for p in some for w in words if w.startswith(p))


def test_index_incremental_folds_the_log_once(spark, sf_small, monkeypatch):
    from prefixery.plans import contract
    read = []
    monkeypatch.setattr(contract.inc, "create_index", lambda s, root, cands, params: read.append(cands.inputFiles()))
    monkeypatch.setattr(contract.inc, "candidate_changes", lambda s, root, cands: read.append(cands.inputFiles()))
    monkeypatch.setattr(contract.inc, "update_index", lambda *a: None)
    monkeypatch.setattr(contract.inc, "read_lists", lambda s, root: s.createDataFrame([], inc.LISTS))
    contract.index_incremental(spark, sf_small)
    assert len(read) == 2 and all(files and not any("term-log" in f for f in files) for files in read)
