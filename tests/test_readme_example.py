"""The README's library example, on inputs derived from sf0.001."""

from prefixery import (build_index, candidates, catalog_top_n, decayed_state, fold_query_log,
                       nested_index, suggest_bulk, to_catalog, upsert)
from prefixery.session import scratch_path
from prefixery.sources import tables


def test_readme_example(spark, sf_small):
    raw, ev, rq = (scratch_path(spark, n) for n in ("ex-raw", "ex-ev", "ex-rq"))
    tables.term_log(spark, sf_small).write.parquet(raw)
    tables.search_events(spark, sf_small).select("query", "ts_ms").write.parquet(ev)
    tables.requests(spark, sf_small).write.parquet(rq)

    log = spark.read.parquet(raw + "/*.parquet").select("final_search_term", "popularity")
    catalog = to_catalog(catalog_top_n(fold_query_log(log)))
    events = spark.read.parquet(ev)
    catalog = upsert(catalog, decayed_state(events))
    index = build_index(candidates(catalog))
    answers = suggest_bulk(spark.read.parquet(rq), nested_index(index))

    statuses = {r["status"] for r in answers.select("status").distinct().collect()}
    assert "FOUND" in statuses and "BYPASS" in statuses
