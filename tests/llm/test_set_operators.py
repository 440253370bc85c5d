"""The join and the mixing against plain Python."""

import os
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from prefixery.llm import jaccard_join, set_links, source_mixing
from prefixery.llm.common import discard, scratch_scope, stored
from prefixery.llm.components import components


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """rows: (doc_id, text); a repeated id is one node."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check_join(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components([r for r in rows if r[0] is not None])
    got = jaccard_join.join(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(
        (i, len(shingles(t)), None if i is None else want[i]) for i, t in rows)
    return got


def chains(seed, n, size):
    """Groups of texts that drift: neighbours link, distant ones do not."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = [f"w{r.randrange(10 ** 6)}" for _ in range(size)]
        for _ in range(r.randint(1, 6)):
            out.append((len(out) * 7 % 1009, " ".join(text)))
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                text[r.randrange(size)] = f"w{r.randrange(10 ** 6)}"
    return out


def test_join_equals_brute_force(spark, edge_docs, sample_docs, empty_docs):
    check_join(edge_docs)
    check_join(sample_docs)
    got = check_join(spark.createDataFrame(chains(3, 40, 70), "doc_id long, text string").repartition(5))
    sizes = Counter(r["component_id"] for r in got)
    assert max(sizes.values()) >= 4
    assert jaccard_join.join(empty_docs).count() == 0


def test_join_of_texts_that_share_passages(spark, monkeypatch):
    """Many texts share a passage and fall into one group of many blocks."""
    monkeypatch.setattr(set_links, "BLOCK", 500)
    r = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"q{k // 2}-{j}" for j in range(18)]
        if k % 2:
            own[r.randrange(18)] = "other"
        rows.append((k, " ".join(passage + own)))
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_rtree_finds_every_pair_within_the_bound():
    r = np.random.default_rng(1)
    n = r.integers(20, 90, 300)
    vec = np.stack([np.bincount(r.integers(0, 8, x), minlength=jaccard_join.GROUPS) for x in n]).astype(np.uint16)
    comp = r.integers(0, 40, 300)
    q, p, _ = jaccard_join.RTree(n, vec).search(n, vec, comp, comp)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    for a in range(300):
        for b in range(300):
            bound = np.minimum(vec[a], vec[b]).sum()
            want = (comp[a] != comp[b] and 4 * n[b] >= 3 * n[a] and 4 * n[a] >= 3 * n[b]
                    and bound >= -(-3 * (n[a] + n[b]) // 7))
            assert ((a, b) in got) == want


def test_representatives(edge_docs, sample_docs, empty_docs):
    kept = jaccard_join.representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([None, None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15])
    want = brute_components([(r["doc_id"], r["text"]) for r in sample_docs.collect()])
    assert sorted(r["doc_id"] for r in jaccard_join.representatives(sample_docs).collect()) == sorted(set(want.values()))
    assert jaccard_join.representatives(empty_docs).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 299), (299, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((299, 300, 301), 299)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ op3

@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 500, "b": 499, "c": 1}, {f"s{k}": k + 1 for k in range(17)}])
def test_period_is_pfair(weights):
    share = source_mixing.integer_weights(weights, 100)
    q = sum(share.values())
    slots = source_mixing.period(share)
    assert sorted(x for s in slots.values() for x in s) == list(range(q))
    for s, own in slots.items():
        for i, t in enumerate(own):
            assert i * q // share[s] <= t < -(-(i + 1) * q // share[s])
    assert source_mixing.largest_deviation(share) < 1
    assert all(abs(Fraction(share[s], q) - Fraction(weights[s], sum(weights.values()))) < Fraction(len(share), q) for s in share)


def test_schedule_places_every_document_once(spark, edge_docs, empty_docs):
    r = random.Random(2)
    rows = [(k, f"t{k}", r.choice("aaaaabbc")) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    weights = {"a": 1, "b": 2, "c": 1, "absent": 9}
    got = source_mixing.schedule(docs, weights, block=8, quantum=20).orderBy("mix_position").collect()
    assert [x["mix_position"] for x in got] == list(range(700))
    assert all(x["mix_release"] <= x["mix_slot"] < x["mix_deadline"] for x in got)
    for s in "abc":
        own = [x["doc_id"] for x in got if x["source"] == s]
        assert own == sorted(own)
    placed, seen = Counter(), Counter(s for _, _, s in rows)
    for x in got:
        placed[x["source"]] += 1
        if min(seen[s] - placed[s] for s in "abc") < 8:
            break
        total = sum(placed.values())
        for s, w in (("a", 5), ("b", 10), ("c", 5)):            # the target in twentieths
            assert abs(placed[s] - total * w / 20) < 16         # a block, and one in the making
    odd = source_mixing.schedule(edge_docs, block=2)
    assert sorted(x["mix_position"] for x in odd.collect()) == list(range(edge_docs.count()))
    assert set(edge_docs.columns) - {"mix_slot"} <= set(odd.columns)
    assert source_mixing.schedule(empty_docs).count() == 0
    assert source_mixing.mixed(edge_docs.drop("mix_slot")).count() == edge_docs.count()
    with pytest.raises(ValueError):
        source_mixing.schedule(docs, {"a": 1, "b": 0, "c": 1})


@pytest.mark.parametrize("weights", [{"a": 0.25, **{f"s{k}": 0.75 / 19 for k in range(19)}},
                                     {"a": 0.9, **{f"s{k}": 0.1 / 249 for k in range(249)}}, {"a": 1 - 1e-5, "b": 1e-5}])
def test_schedule_follows_the_given_weights(weights):
    """Less than one block from the weights as given, over a long first phase."""
    blocks = {s: int(w * 200_000) + 1 for s, w in weights.items()}
    plan = source_mixing.phases(blocks, source_mixing.integer_weights(weights), 1)
    first = [r for r in plan if r[3] == 0]
    ends = 1 + max(r[-1][-1] for r in first)
    assert ends > 100_000
    for s, _, _, _, _, _, _, slots in first:
        i, t = np.arange(len(slots)), np.array(slots)
        w = weights[s] / sum(weights.values())
        assert np.abs(i - w * t).max() < 1.001 and np.abs(i + 1 - w * (t + 1)).max() < 1.001


def test_schedule_in_pieces(spark, monkeypatch):
    """A plan written out in parts and joined by shuffle gives the same rows."""
    rows = [(k, f"t{k}", "aaab"[k % 4]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(source_mixing.schedule(docs, {"a": 2, "b": 1}, block=2).collect())
    monkeypatch.setattr(source_mixing, "PIECE", 8)
    monkeypatch.setattr(source_mixing, "HELD", 60)
    monkeypatch.setattr(source_mixing, "BROADCAST_SLOTS", 0)
    assert sorted(source_mixing.schedule(docs, {"a": 2, "b": 1}, block=2).collect()) == want


def test_link_counts_equal_brute_force(spark, edge_docs, monkeypatch):
    """Every link counts, in groups of one block and of many; equal sets link."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    near = []
    for k in range(60):
        own = list(base)
        for _ in range(k % 7):
            own[r.randrange(150)] = f"x{r.randrange(1000)}"
        near.append((2000 + k, " ".join(own)))
    rows = [(x["doc_id"], x["text"]) for x in edge_docs.collect()] + chains(4, 20, 60) + near
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    want = Counter((i, sum(bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for _, b in sets) - bool(a)) for i, a in sets)
    want.update((i, 0) for i, _ in rows if i is None)
    monkeypatch.setattr(set_links, "BLOCK", 2000)
    assert Counter((x["doc_id"], x["n_links"]) for x in jaccard_join.join(docs, all_links=True).collect()) == want


def test_pairs_of_blocks_are_dealt_one_by_one(spark):
    """A group of many blocks: each pair of them is a part of its own."""
    rows = [(1, k, 12, 1, k, b"") for k in range(300)] + [(k, 1000 + k, 1, 1, k, b"") for k in range(2, 30)]
    groups = spark.createDataFrame(rows, "root long, node long, blocks long, members long, label long, hashes binary")
    met = set_links.dealt_in_pairs(groups, 4).where("root = 1").select("part", "i", "j").distinct().collect()
    assert {(x["i"], x["j"]) for x in met} == {(i, j) for j in range(12) for i in range(j + 1)}
    assert len({x["part"] for x in met}) == len(met) == 78


def test_waves_have_each_pair_of_blocks_once(spark):
    """A group of b blocks moves b copies of its sets: a wave moves its share."""
    rows = [(1, k, 12, 1, k, b"") for k in range(300)] + [(k, 1000 + k, 1, 1, k, b"") for k in range(2, 30)]
    groups = spark.createDataFrame(rows, "root long, node long, blocks long, members long, label long, hashes binary")
    columns = ["root", "i", "j", "node"]
    whole = Counter(map(tuple, set_links.dealt_in_pairs(groups, 4).select(*columns).collect()))
    waves = [Counter(map(tuple, set_links.dealt_in_pairs(groups, 4, k, 5).select(*columns).collect())) for k in range(5)]
    assert sum(waves, Counter()) == whole
    assert max(w.total() for w in waves) < whole.total() / 4


def test_jaccard_in_waves(spark, edge_docs, monkeypatch):
    rows = [(x["doc_id"], x["text"]) for x in edge_docs.collect() if x["doc_id"] not in (None, 10)] + chains(4, 20, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {tuple(x) for x in jaccard_join.join(docs, all_links=True).collect()}
    monkeypatch.setattr(set_links, "BLOCK", 500)
    monkeypatch.setattr(set_links, "WAVE", 100)
    with scratch_scope() as paths:
        assert {tuple(x) for x in jaccard_join.join(docs, all_links=True).collect()} == want
    assert sum("set-wave" in p for p in paths) > 4


def test_jaccard_leaves_no_intermediate_entries(spark, sample_docs):
    """Neither the shuffle files of what is stored nor the tables of entries stay on disk."""
    docs = sample_docs.limit(200)
    with scratch_scope() as paths:
        out = jaccard_join.join(docs)
    left = {re.sub("-[0-9a-f]{12}$", "", os.path.basename(p)) for p in paths if os.path.exists(p.removeprefix("file:"))}
    assert "jaccard-out" in left and out.count() == 200
    assert not left & {"jaccard-packed", "jaccard-shared", "jaccard-common", "jaccard-entries", "jaccard-pivots", "jaccard-signatures",
                       "components-large", "components-minima"}


def test_stored_removes_its_shuffle_files(spark):
    def shuffles():
        return set(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keySet().mkString(" ").split())

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key)
    table = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "shuffled")
    new = shuffles() - before
    assert table.count() == 10 and spark.conf.get(key) == setting
    table.groupBy("k").count().write.format("noop").mode("overwrite").save()
    assert not new and shuffles() - before           # other queries keep theirs
    discard(table)
    assert not os.path.exists(table.stored_at.removeprefix("file:"))


def near_copies(n, size, changes, seed=1):
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 1 << 60, size).astype(np.uint64))
    out = []
    for _ in range(n):
        own = base.copy()
        own[r.integers(0, len(own), changes)] = r.integers(0, 1 << 60, changes).astype(np.uint64)
        out.append(np.unique(own))
    return out


def test_near_copies_cost_one_pass():
    """4,000 near copies in one place: hubs, not pairs."""
    sets = near_copies(4000, 40, 2)
    whole = np.arange(len(sets))
    began = time.process_time()
    got = jaccard_join._spanning(sets, whole, whole, whole)
    assert time.process_time() - began < 5
    assert len({x for pair in got for x in pair}) == len(sets)


@pytest.mark.parametrize("changes", [3, 8, 14])
def test_spanning_links_connect_what_links_connect(changes):
    sets = near_copies(90, 60, changes, changes) + near_copies(40, 50, 3, 99)
    label = np.arange(len(sets))
    label[:6] = 0                                             # known to be connected
    whole = np.arange(len(sets))
    for left, right in ((whole, whole), (whole[:70], whole[70:])):
        got = jaccard_join._spanning(sets, label, left, right)
        parent = {}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def joined(pairs):
            parent.update({k: k for k in whole})
            for a, b in pairs:
                x, y = find(int(a)), find(int(b))
                parent[max(x, y)] = min(x, y)
            return [find(k) for k in whole]

        def linked(a, b):
            both = len(np.intersect1d(sets[a], sets[b]))
            return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

        known = [(0, k) for k in range(6)]
        true = [(a, b) for a in left for b in right if a != b and linked(a, b)]
        assert all(linked(a, b) for a, b in got)
        assert joined([*true, *got, *known]) == joined([*got, *known])


def test_rows_of_equal_keys_are_each_placed(spark):
    """Repeated rows, equal ids with other texts or sources, null ids."""
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (1, "a", "t"), (None, "a", "s"), (None, "a", "s"), (None, None, None),
            (2, None, None), (2, None, "")] + [(k, f"t{k}", "st"[k % 2]) for k in range(3, 40)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n long")
    for few in (True, False):
        got = source_mixing.schedule(docs, block=2).collect() if few else source_mixing.schedule(docs.repartition(7), block=2).collect()
        assert sorted(x["mix_position"] for x in got) == list(range(len(rows)))
        assert sorted(x["n"] for x in got) == list(range(len(rows)))
