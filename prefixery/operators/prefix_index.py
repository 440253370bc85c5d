"""Per-prefix top-K completions, materialised as a table.

Every candidate query is exploded into its prefixes (including the empty
one) and ranked within each prefix.  ``row_number() <= K`` is planned as a
partial WindowGroupLimit before the shuffle and a final one after it, so a
hot prefix (the empty prefix gets every row) moves at most K rows per map
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexParams
from ..functions.normalize import prefix_lengths
from ..functions.scoring import blended_score
from .recency import decay_to
from .topn import top_n, top_n_by_count


def candidates(catalog: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """Candidate cut then score: ``(query, score)``.

    The cut keeps the ``max_queries`` most popular queries (by all-time count;
    ``cut_by='score'`` cuts on the blended score instead)."""
    if params.decay_to_ms is not None:
        catalog = decay_to(catalog, params.decay_to_ms)
    recent = F.col("recent_score") if "recent_score" in catalog.columns else None
    scored = catalog.select("query", "all_time_count",
                            blended_score("all_time_count", recent, params.w_all_time,
                                          params.w_recent).alias("score"))
    if params.cut_by == "count":
        cut = top_n_by_count(scored, params.max_queries, "all_time_count", "query")
    else:
        cut = top_n(scored, params.max_queries, [F.desc("score"), F.asc("query")])
    return cut.select("query", "score")


def explode_prefixes(cands: DataFrame, max_prefix_len: int | None = None) -> DataFrame:
    """One row per query and prefix.  The lengths are exploded, not the
    prefixes, so a row never holds more than one of its prefixes."""
    return (cands.select(F.explode(prefix_lengths("query", max_prefix_len)).alias("_n"), "query", "score")
            .select(F.expr("substring(query, 1, _n)").alias("prefix"), "query", "score"))


def build_index(cands: DataFrame, k: int = 10, max_prefix_len: int | None = None) -> DataFrame:
    """Flat index ``(prefix, rank, query, score)``; rank 1..n, n <= k, ordered
    by score descending then query ascending."""
    w = Window.partitionBy("prefix").orderBy(F.desc("score"), F.asc("query"))
    return (explode_prefixes(cands, max_prefix_len)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("prefix", "rank", "query", "score"))


def nested_index(index: DataFrame) -> DataFrame:
    """``(prefix, suggestions ARRAY<STRUCT<query, score>>)`` in rank order.
    Groups hold at most K rows."""
    return (index.groupBy("prefix")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "query", "score"))).alias("s"))
            .select("prefix", F.transform("s", lambda x: F.struct(
                x["query"].alias("query"), x["score"].alias("score"))).alias("suggestions")))


def index_stats(cands: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates, trie nodes (distinct prefixes incl. the empty one), index rows.
    Every prefix has exactly one rank-1 row, so nodes need no distinct
    aggregation.  Two one-row aggregates stacked and folded (no join)."""
    nul = F.lit(None).cast("bigint")
    c = cands.agg(F.count(F.lit(1)).alias("candidates"), nul.alias("nodes"),
                  nul.alias("index_rows"))
    i = index.agg(nul.alias("candidates"),
                  F.sum((F.col("rank") == 1).cast("long")).alias("nodes"),
                  F.count(F.lit(1)).alias("index_rows"))
    return c.unionByName(i).agg(*[F.max(x).alias(x) for x in
                                  ("candidates", "nodes", "index_rows")])
