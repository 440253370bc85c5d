"""The burst trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from prefixery.llm import burst_trie as bt

SCHEMA = "conv_id long, turn int, role string, text string"


def own_turns(rows):
    """Original turns per conversation, in order; equal turns by their names."""
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append((turn is not None, turn or 0, name, role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(rows):
    own, out = own_turns(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """Node rows from every prefix of every conversation."""
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        key = tuple(turns)
        for d in range(len(key) + 1):
            members[key[:d]].append(c)
            if d:
                below[key[:d - 1]].add(key[:d])
        ends[key].append(c)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in below[p])
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def invented(seed, n):
    """Conversations that share first turns, some of them equal."""
    r = random.Random(seed)
    rows, scripts = [], [[("user" if k % 2 == 0 else "assistant", f"text {r.randrange(4)}" + "é" * r.randrange(3)) for k in range(12)]
                         for _ in range(4)]
    for c in range(n):
        script = scripts[0] if c % 3 == 0 else r.choice(scripts)
        turns = script[:r.randrange(13)] if c % 2 else script[:7] + [("user", f"own {r.randrange(60)}")]
        rows += [(c * 3 - 20, k, *t) for k, t in enumerate(turns or script[:1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit, step", [(64, 8), (1, 2), (5, 3)])
def test_trie_equals_dictionary(spark, limit, step):
    rows = invented(limit, 160)
    got = bt.trie(bt.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(3)), limit, step)
    assert rows_of(got) == brute(rebuilt(rows))


def test_query_equals_dictionary(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = bt.op12_burst_trie(spark, sf_small)
    assert got.columns == [f.split()[0] for f in bt.NODE.split(", ")]
    assert rows_of(got) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(5, 0, "user", "a"), (5, 1, None, None), (5, None, "user", "first"), (5, None, None, "also first"), (5, 1, "x", "tie"),
            (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 3, "", ""), (None, 0, "user", "lost"), (-7, 0, "user", "a"), (-5, 1, "", "é" * 9),
            (10, 0, "user", "y" * 200_000), (11, 0, "user", "y" * 200_000), (12, 2, "us", "era"), (13, 2, "user", "a")]
    rows += [(100 + k, t, "user", "same") for k in range(40) for t in range(3)]
    df = spark.createDataFrame([r + ("p", 1) for r in rows], SCHEMA + ", path string, n_convs int")
    for limit in (64, 2):
        assert rows_of(bt.trie(bt.rebuilt(df), limit)) == brute(rebuilt(rows))


def test_deep_copies_burst_to_their_end(spark):
    rows = [(k, t, "r", f"t{t}" if t < 20 else f"t{t}-{k % 3}") for k in range(30) for t in range(25)]
    plain = bt.paths(bt.turns(spark.createDataFrame(rows, SCHEMA)))
    want = brute(own_turns(rows))
    for limit, step in ((2, 4), (1, 8), (64, 8)):
        assert rows_of(bt.trie(plain, limit, step)) == want


def test_empty_table(spark):
    got = bt.trie(bt.rebuilt(spark.createDataFrame([], SCHEMA)))
    assert got.count() == 0
