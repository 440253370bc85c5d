"""Consistent-hash ring: distribution, remap, wrap-around, empty ring."""

from pyspark.sql import functions as F

from prefixery.operators import ring as rg
from prefixery.operators.export import node_label


def _keys(spark, n=100_000):
    return spark.range(n).select(F.concat(F.lit("suggest:v1:prefix-"), F.col("id").cast("string"))
                                 .alias("key"))


def test_distribution(spark):
    sh = rg.share(rg.assign(_keys(spark), "key", rg.ring_points(spark, (0, 1, 2), 150))).collect()
    assert len(sh) == 3
    for r in sh:
        assert 0.28 <= r["share"] <= 0.39


def test_remap_only_departed_node(spark):
    before = rg.ring_points(spark, (0, 1, 2), 150)
    after = rg.ring_points(spark, (0, 1), 150)
    r = rg.remap(_keys(spark), "key", before, after).collect()[0]
    assert 0.28 <= r["moved_share"] <= 0.39
    assert r["survivor_kept"] == r["survivor_keys"]


def test_matches_array_scan(spark):
    pts = sorted((r["pos"], r["node"]) for r in rg.ring_points(spark, (0, 1, 2), 150).collect())
    got = {r["key"]: r["node"] for r in
           rg.assign(_keys(spark, 3000), "key", rg.ring_points(spark, (0, 1, 2), 150)).collect()}
    import hashlib
    for k, node in got.items():
        h = int(hashlib.md5(k.encode()).hexdigest()[:15], 16)
        owner = next((n for p, n in pts if p >= h), pts[0][1])
        assert node == owner


def test_wrap_and_empty(spark):
    pts = spark.createDataFrame([(10, 1), (20, 2)], "pos bigint, node int")
    arcs = sorted(tuple(r) for r in rg.ring_arcs(pts).collect())
    assert arcs == [(-1, 10, 1), (10, 20, 2), (20, (1 << 60) - 1, 1)]
    empty = rg.ring_points(spark, (), 150)
    out = rg.assign(_keys(spark, 5), "key", empty).select(node_label(F.col("node")).alias("n"))
    assert {r["n"] for r in out.collect()} == {"none"}
