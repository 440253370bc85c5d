"""SuperMinHash near-duplicates against all pairs, and the signatures against their definition."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import words

from prefixery.llm import set_links
from prefixery.llm import superminhash as smh
from prefixery.llm.arrowtext import mix


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def links(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 85 * (len(a) + len(b) - both)


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if links(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components([r for r in rows if r[0] is not None])
    got = smh.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got) == Counter(
        (i, len(shingles(t)), None if i is None else want[i], i is None or want[i] == i) for i, t in rows)


def chains(seed, n, size):
    """Groups of texts that drift: neighbours link, distant ones do not."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = [f"w{r.randrange(10 ** 6)}" for _ in range(size)]
        for _ in range(r.randint(1, 7)):
            out.append((len(out) * 7 % 1009, " ".join(text)))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(size)] = f"w{r.randrange(10 ** 6)}"
    return out


def test_classes_equal_all_pairs(spark):
    """Short, middling and long texts."""
    rows = [(k * 1009 + i, t) for k, size in enumerate((8, 60, 400)) for i, t in chains(size, 40, size)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_large_group_over_many_blocks(spark, monkeypatch):
    """Near copies of one text, some of which link only through others, in small blocks."""
    monkeypatch.setattr(set_links, "BLOCK_SETS", 20)
    r = random.Random(5)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(80)]
    rows = []
    for k in range(240):
        text = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6, 8])):
            text[r.randrange(80)] = f"x{r.randrange(10 ** 6)}"
        rows.append((k, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_given_documents(spark, sample_docs):
    check(sample_docs)


def test_odd_rows(edge_docs, empty_docs):
    check(edge_docs)
    got = smh.near_duplicates(empty_docs)
    assert got.count() == 0 and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def one_by_one(x):
    """The signature as defined: every element's whole permutation."""
    out = [None] * smh.SLOTS
    for e in x.tolist():
        p = list(range(smh.SLOTS))
        for j in range(smh.SLOTS):
            v = int(mix(np.array([e], np.uint64) ^ smh._STEP[j])[0])
            k = j + ((v & 0xFFFF) * (smh.SLOTS - j) >> 16)
            p[j], p[k] = p[k], p[j]
            offer = (j << 48) | (v >> 16)
            if out[p[j]] is None or offer < out[p[j]]:
                out[p[j]] = offer
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 60, 700])
def test_signatures_equal_definition(size):
    r = np.random.default_rng(size)
    sets = [np.unique(r.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(3)]
    assert smh.signatures(sets).tolist() == [one_by_one(x) for x in sets]


def test_signature_estimates_jaccard_with_lower_variance():
    r = np.random.default_rng(9)
    errors = []
    for _ in range(300):
        x = r.integers(0, 1 << 63, 150).astype(np.uint64)
        a, b = x[:110], x[40:]
        s = smh.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - 70 / 150)
    plain = 70 / 150 * (1 - 70 / 150) / smh.SLOTS             # variance of independent hashes
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.95 * plain


@pytest.mark.parametrize("hubs", [1, 3, 24])
def test_hub_links_connect_what_links_connect(monkeypatch, hubs):
    monkeypatch.setattr(smh, "HUBS", hubs)
    r = np.random.default_rng(hubs)
    sets, base = [], np.unique(r.integers(0, 1 << 60, 100).astype(np.uint64))
    for k in range(120):
        if k % 40 == 0:
            base = np.unique(r.integers(0, 1 << 60, 100).astype(np.uint64))
        own = base.copy()
        own[r.integers(0, len(own), r.integers(1, 9))] = r.integers(0, 1 << 60)
        sets.append(np.unique(own))
    node, whole = np.arange(len(sets)), np.arange(len(sets))
    for left, right in ((whole, whole), (whole[:50], whole[50:])):
        got = smh._hub_links(node, sets, np.ones(len(sets)), node, left, right)
        parent = {k: k for k in range(len(sets))}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def joined(pairs):
            for k in parent:
                parent[k] = k
            for a, b in pairs:
                x, y = find(int(a)), find(int(b))
                parent[max(x, y)] = min(x, y)
            return [find(k) for k in parent]

        true = [(a, b) for a in left for b in right if a != b
                and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in got)
        assert joined([*true, *got]) == joined(got)
