"""Prefix index: hand-made cases, invariants and brute force on sf0.001."""

from collections import defaultdict

from pyspark.sql import functions as F

from prefixery.config import IndexParams
from prefixery.operators import lookup as lk
from prefixery.operators import prefix_index as px
from prefixery.operators.topn import top_n
from prefixery.plans import contract


def _cands(spark, rows):
    return spark.createDataFrame(rows, "query string, score double")


def test_topk_merge_children(spark):
    rows = [(f"a{i:02d}", 100.0 + i) for i in range(12)] + [(f"b{i:02d}", float(i)) for i in range(12)]
    idx = px.build_index(_cands(spark, rows))
    root = [r["query"] for r in lk.lookup(idx, "").collect()]
    assert root == [f"a{i:02d}" for i in range(11, 1, -1)]


def test_ties_query_ascending(spark):
    idx = px.build_index(_cands(spark, [("ab", 1.0), ("aa", 1.0), ("ac", 1.0)]))
    assert [r["query"] for r in lk.lookup(idx, "a").collect()] == ["aa", "ab", "ac"]


def test_terminal_inside_path(spark):
    idx = px.build_index(_cands(spark, [("iphone", 9.0), ("iphone case", 7.0)]))
    got = [(r["query"], r["score"]) for r in lk.lookup(idx, "iphone").collect()]
    assert got == [("iphone", 9.0), ("iphone case", 7.0)]
    assert [r["query"] for r in lk.lookup(idx, "iph").collect()] == ["iphone", "iphone case"]


def test_bulk_no_match_and_blank(spark):
    idx = px.build_index(_cands(spark, [("iphone", 9.0), ("iphone case", 7.0)]))
    req = spark.createDataFrame([(1, "zzz"), (2, "  "), (3, " IPH"), (4, None)],
                                "request_id bigint, raw_prefix string")
    out = lk.suggest_bulk(req, px.nested_index(idx)).collect()
    by = defaultdict(list)
    for r in out:
        by[r["request_id"]].append(r)
    assert [r["status"] for r in by[1]] == ["EMPTY"] and by[1][0]["query"] is None
    assert [r["status"] for r in by[2]] == ["BYPASS"]
    assert [r["status"] for r in by[4]] == ["BYPASS"]
    assert [(r["rank"], r["query"], r["match_head"], r["match_tail"]) for r in
            sorted(by[3], key=lambda r: r["rank"])] == [(1, "iphone", "iph", "one"),
                                                        (2, "iphone case", "iph", "one case")]


def test_top_n_range_path_equals_sort(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"q{i}", rnd.randrange(0, 50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "q string, cnt bigint")
    for n in (1, 1234, 4999, 5000, 7000):
        got = sorted((r["q"], r["cnt"]) for r in
                     top_n(df, n, [F.desc("cnt"), F.asc("q")]).collect())
        want = sorted(sorted(rows, key=lambda x: (-x[1], x[0]))[:n])
        assert got == want, n


def test_large_neighbouring_counts_rank_by_count(spark):
    cat = spark.createDataFrame([("aa", 5_000_000), ("ab", 5_000_001), ("ac", 5_000_002)], "query string, all_time_count bigint")
    idx = px.build_index(px.candidates(cat))
    assert [r["query"] for r in lk.lookup(idx, "a").collect()] == ["ac", "ab", "aa"]


def test_decay_at_build_time_reorders(spark):
    hour = 3_600_000
    cat = spark.createDataFrame([("old", 10, 5.0, 0), ("new", 10, 4.0, 48 * hour)],
                                "query string, all_time_count bigint, recent_score double, last_ms bigint")
    top = lambda p: [r["query"] for r in lk.lookup(px.build_index(px.candidates(cat, p)), "").collect()]
    assert top(IndexParams()) == ["old", "new"]
    assert top(IndexParams(decay_to_ms=48 * hour)) == ["new", "old"]


def test_long_query_explodes_in_little_memory(spark):
    idx = px.build_index(_cands(spark, [("x" * 3000, 1.0), ("y", 2.0)]))
    assert idx.count() == 3001 + 2


def test_index_brute_force_and_invariants(spark, sf_small):
    cat = contract._base_catalog(spark, sf_small)
    cands = px.candidates(cat, IndexParams())
    idx = px.build_index(cands)
    rows = idx.collect()
    cand_rows = [(r["query"], r["score"]) for r in cands.collect()]
    brute = defaultdict(list)
    for q, s in cand_rows:
        for i in range(len(q) + 1):
            brute[q[:i]].append((q, s))
    got = defaultdict(list)
    for r in rows:
        assert r["query"].startswith(r["prefix"])
        got[r["prefix"]].append((r["rank"], r["query"], r["score"]))
    assert set(got) == set(brute)
    for p, lst in got.items():
        lst.sort()
        assert [x[0] for x in lst] == list(range(1, len(lst) + 1)) and len(lst) <= 10
        want = sorted(brute[p], key=lambda x: (-x[1], x[0]))[:10]
        assert [(x[1], x[2]) for x in lst] == want
    trend = [(r["query"], r["score"]) for r in lk.trending(cands).collect()]
    assert trend == [(x[1], x[2]) for x in sorted(got[""])]


def test_csv_round_trip_sends_whole_texts(spark, sf_small, monkeypatch):
    from prefixery.plans import contract
    sent = {}
    write = contract.catalog_io.write_folded_csv

    def noted(rows, path):
        sent.update({r["cnt"]: r["q"] for r in rows.collect()})
        return write(rows, path)

    monkeypatch.setattr(contract.catalog_io, "write_folded_csv", noted)
    n = contract.csv_round_trip(spark, sf_small).count()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert n == len(texts) == len(sent)
    assert max(map(len, texts.values())) > 200 and all(texts[k] in q for k, q in sent.items())
