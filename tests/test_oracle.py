"""Every contract query against its DuckDB oracle on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from prefixery.plans.contract import QUERIES
from prefixery.plans.oracle_sql import ORACLES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    """Of this part; the optional subpackage has operators that SQL cannot express."""
    assert set(ORACLES) == set(QUERIES) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sdf = E.queries()[name](spark, sf_small)
    sc, sr = _rows(sdf.toPandas())
    dc, dr = _rows(duck.sql(E.oracle_sql()[name]).df())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["prefix", "rank", "query", "score"]
    assert df.count() > 0
