"""Offline fold of a raw query log into the popularity catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_N
from ..functions.normalize import normalize
from .topn import top_n_by_count


def fold_query_log(log: DataFrame, term_col: str = "final_search_term",
                   pop_col: str = "popularity", mode: str = "loader") -> DataFrame:
    """``(q, cnt)``: popularity once per exact term (max), then summed over the
    variants that normalise to the same key.  Null terms and blank keys drop.

    Two aggregations, two shuffles (term, then q); both are partial+final hash
    aggregates, so a hot term is combined map-side before it moves.
    """
    per_term = (log.where(F.col(term_col).isNotNull())
                .groupBy(term_col).agg(F.max(pop_col).alias("p")))
    keyed = per_term.select(normalize(term_col, mode).alias("q"), "p")
    return (keyed.where(F.length("q") > 0)
            .groupBy("q").agg(F.sum("p").alias("cnt")))


def catalog_top_n(folded: DataFrame, n: int = TOP_N) -> DataFrame:
    """Top ``n`` folded queries by count; ties by query ascending."""
    return top_n_by_count(folded, n, "cnt", "q")


def catalog_summary(catalog: DataFrame, col: str = "cnt") -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.min(col).alias("min_cnt"),
                       F.max(col).alias("max_cnt"))


def to_catalog(top: DataFrame) -> DataFrame:
    """Full-refresh load: the folded CSV columns plus the store's defaults
    (``recent_score`` 0; ``last_ms`` null until the first event touches it)."""
    return top.select(F.col("q").alias("query"),
                      F.col("cnt").alias("all_time_count"),
                      F.lit(0.0).alias("recent_score"),
                      F.lit(None).cast("bigint").alias("last_ms"))
