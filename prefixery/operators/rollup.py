"""Per-prefix top-K, merged bottom-up from the longest prefixes.

A query that is among the best K of a short prefix is among the best K of each
longer prefix of its own.  So the ranking goes through ranges of prefix lengths, from
the longest: a range gets the queries that end in it, and of the longer ones only
those that were among the K best at the next range's shortest prefix.  A prefix with
a million queries below it receives K rows for each longer prefix instead of a
million.  The candidates and every range are stored, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CUTS = (6, 3, 0)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rollup_index(cands: DataFrame, k: int = 10, max_prefix_len: int | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Flat index ``(prefix, rank, query, score)``, equal to ``prefix_index.build_index``.

    ``cuts``: the shortest length of each range, falling to 0; single lengths
    (``range(n, -1, -1)``) merge level by level."""
    if not cuts or cuts[-1] != 0 or list(cuts) != sorted(set(cuts), reverse=True):
        raise ValueError("cuts must fall to 0")
    own = F.length("query") if max_prefix_len is None else F.least(F.length("query"), F.lit(max_prefix_len))
    best = Window.partitionBy("prefix").orderBy(F.desc("score"), F.asc("query"))
    rows = _stored(cands.select("query", "score", own.alias("_end")), "rollup-candidates")
    out, above, top = None, None, None
    for low in cuts:
        part = rows.where(F.col("_end") >= low) if top is None else rows.where((F.col("_end") >= low) & (F.col("_end") < top))
        if above is not None:
            part = part.unionByName(above.withColumn("_end", F.lit(top - 1)))
        ranked = (part.select(F.explode(F.sequence(F.lit(low), F.col("_end"))).alias("_n"), "query", "score")
                  .select(F.expr("left(query, _n)").alias("prefix"), "query", "score")
                  .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                  .select("prefix", "rank", "query", "score"))
        ranked = _stored(ranked, f"rollup-{low}")
        above = ranked.where(F.length("prefix") == low).select("query", "score")
        top = low
        out = ranked if out is None else out.unionByName(ranked)
    return out
