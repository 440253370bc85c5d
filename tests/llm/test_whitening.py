"""Whitening against numpy's dense eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from prefixery.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def entries(rows):
    """The contract's fit list: (vec_id, long entries) of the usable rows."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, *_ in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    usual = max(set(sizes), key=lambda k: (sizes.count(k), k)) if sizes else 0
    return [(i, v) for i, v in good if len(v) == usual]


def check(spark, rows, components=wh.COMPONENTS):
    got = wh.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), components).collect()
    fit = entries(rows)
    n = len(fit)
    x = np.array([v for _, v in fit], dtype=np.int64)
    sums = x.sum(axis=0)
    centred = (x * n - sums) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    keep = min(components, int((value > 1e-12 * value[0]).sum()))
    assert len(got) == n * keep
    want = {}
    for (i, v), y in zip(fit, centred @ vector[:, :keep] / np.sqrt(value[:keep]), strict=True):
        want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True)), y))
    seen = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] - value[r["component"] - 1] / value.sum()) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9
        seen.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], r["whitened"]))
    for k in range(1, keep + 1):
        gap = min(abs(value[k - 1] - value[j]) for j in range(len(value)) if j != k - 1) / value[0] if len(value) > 1 else 1
        if gap < 1e-6:
            continue
        sign = None
        for i, rows_i in want.items():
            ours = sorted(seen[i, k])
            theirs = sorted((d, y[k - 1]) for d, y in rows_i)
            assert [d for d, _ in ours] == [d for d, _ in theirs]
            if sign is None and abs(theirs[0][1]) > 1e-3 and len(ours) == 1:
                sign = math.copysign(1, theirs[0][1] * ours[0][1])
            if len(ours) == 1 and sign:
                assert abs(ours[0][1] - sign * theirs[0][1]) < 1e-7 * max(1, 1 / gap * 1e-3)
    return got


def test_whitening_equals_dense_eigendecomposition(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(c) for c in r.normal(size=6) * [1, 2, 3, 4, 5, 0]], 0) for k in range(200)]      # a constant dimension
    rows += [rows[0]] * 90                                                                              # repeated rows
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (503, [math.nan] + [0.0] * 5, None),
             (504, [math.inf] + [0.0] * 5, 2), (505, [1.0] * 7, 3), (None, [0.5] * 5 + [0.0], 4)]
    got = check(spark, rows)
    assert {x["component"] for x in got} == {1, 2, 3, 4, 5} and any(x["vec_id"] is None for x in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(5)]])
def test_nothing_to_whiten(spark, rows):
    got = wh.whitened(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_rows_than_dimensions_and_extra_columns(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(c) for c in r.normal(size=9)], 0) for k in range(4)]
    assert {x["component"] for x in check(spark, rows)} == {1, 2, 3}
    df = spark.createDataFrame([t + ("x", 1) for t in rows], SCHEMA + ", size string, vector int")
    assert wh.whitened(df).count() == 12


def test_entries_too_large_for_exact_longs(spark):
    rows = [(k, [float(2.0 ** (30 + k)), float(k)], 0) for k in range(12)]
    got = wh.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def spectrum_of(x, lanes=wh.LANES):
    s = wh.Spectra(lanes, x.shape[1])
    for k in range(0, len(x), lanes):
        s.add(x[k:k + lanes])
    return s.lanes(s.n > 0).one()


@pytest.mark.parametrize("seed", range(8))
def test_incremental_spectrum_alone(seed):
    """Rank-one updates and merges give the scatter's spectrum without the refinement."""
    r = np.random.default_rng(seed)
    size, n = int(r.integers(1, 20)), int(r.integers(1, 300))
    x = np.floor(64 * r.normal(size=(n, size)) * r.uniform(0.02, 3, size)).astype(np.int64) + wh.SHIFT
    if seed % 2:
        x[n // 3:] = x[0]                                # deflation: mostly one vector
        x[:, 0] = 5
    s = spectrum_of(x)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    scale = max(1.0, np.abs(scatter).max())
    assert s.n[0] == n and (s.sums[0] == x.sum(axis=0)).all()
    assert np.abs(s.u[0].T @ s.u[0] - np.eye(size)).max() < 1e-10
    assert np.abs(s.u[0] * s.d[0] @ s.u[0].T - scatter).max() < 1e-9 * scale
