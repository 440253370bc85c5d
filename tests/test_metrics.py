"""Metrics and weights against brute force."""

import numpy as np

from prefixery.operators import metrics as mt
from prefixery.operators import weights as wt
from prefixery.sources import tables


def test_debounce_brute_force(spark, sf_small):
    ks = tables.keystrokes(spark, sf_small)
    gap = 3_600_000
    got = {r["event_id"] for r in mt.debounce(ks, gap).collect()}
    rows = sorted((r["session"], r["ts_ms"], r["event_id"]) for r in ks.collect())
    want = set()
    for i, (s, t, e) in enumerate(rows):
        nxt = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == s else None
        if nxt is None or nxt[1] - t >= gap:
            want.add(e)
    assert got == want


def test_percentiles_numpy(spark, sf_small):
    log = tables.request_log(spark, sf_small)
    pdf = log.where("outcome <> 'BYPASS'").toPandas()
    assert 0 < len(pdf) < log.count()
    got = {r["outcome"]: r for r in mt.latency_by_outcome(log).collect()}
    for name, part in list(pdf.groupby("outcome")) + [("ALL", pdf)]:
        v = part["latency_ms"].to_numpy()
        for p in (50, 95, 99):
            assert abs(got[name][f"p{p}"] - np.percentile(v, p)) < 1e-6


def test_weighted_sample_brute_force(spark):
    cat = spark.createDataFrame([("apple", 50), ("apricot", 30), ("banana", 15), ("zebra", 5)],
                                "query string, all_time_count bigint")
    cdf = wt.prefix_cdf(wt.prefix_weights(cat))
    table = [(r["p"], r["cdf"]) for r in cdf.orderBy("cdf").collect()]
    draws = spark.createDataFrame([(i, i / 1000.0) for i in range(1000)], "id bigint, u double")
    got = {r["id"]: r["p"] for r in wt.weighted_sample(draws, cdf).collect()}
    for i in range(1000):
        u = i / 1000.0
        assert got[i] == next(p for p, c in table if c >= u)


def test_exact_quantiles_skewed(spark):
    from prefixery.operators.quantiles import exact_quantiles, value_counts
    probs = (0.0, 0.5, 0.95, 0.99, 1.0)
    rng = np.random.default_rng(3)
    hot = rng.exponential(20, 6000).round(2)
    cold = rng.exponential(50, 300).round(2)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 7.0)]
    flat = np.array([3.0] * 4000 + [1.0] * 30 + [9.0] * 50)       # one value holds most rows
    rows += [("flat", float(v)) for v in flat] + [("flat", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(value_counts(df, "g", "v"), "g", probs).collect()}
    for g, arr in (("hot", hot), ("cold", cold), ("one", np.array([7.0])), ("flat", flat)):
        assert got[g]["n"] == len(arr)
        for k, p in enumerate(probs):
            assert abs(got[g][f"q{k}"] - np.percentile(arr, p * 100)) < 1e-9


def test_weights_json_order_and_ties(spark):
    import json
    w = spark.createDataFrame([("ab", 5), ("aa", 5), ("zz", 9), ("ba", 1)], "p string, w bigint")
    doc = json.loads(wt.weights_json(w).collect()[0]["prefixes_json"])
    assert doc == [{"p": "zz", "w": 9}, {"p": "aa", "w": 5}, {"p": "ab", "w": 5}, {"p": "ba", "w": 1}]


def test_approximate_percentiles_close_to_exact(spark, sf_small):
    log = tables.request_log(spark, sf_small)
    exact = {r["outcome"]: r for r in mt.latency_by_outcome(log).collect()}
    approx = {r["outcome"]: r for r in mt.latency_by_outcome(log, exact=False).collect()}
    assert exact.keys() == approx.keys()
    for k in exact:
        assert exact[k]["requests"] == approx[k]["requests"]
        for p in ("p50", "p95", "p99"):
            assert abs(exact[k][p] - approx[k][p]) <= 0.05 * max(1.0, exact[k][p])
