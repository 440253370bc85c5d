"""Prefix popularity weights, their CDF, weighted sampling and JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import WEIGHT_PREFIX_LENGTHS, WEIGHT_PREFIX_LIMIT, WEIGHT_PREFIX_PATTERN
from .range_join import interval_lookup, unit_buckets


def prefix_weights(catalog: DataFrame, lengths=WEIGHT_PREFIX_LENGTHS,
                   pattern: str = WEIGHT_PREFIX_PATTERN,
                   limit: int = WEIGHT_PREFIX_LIMIT) -> DataFrame:
    """``(p, w)``: summed all-time counts of the 2- and 3-character prefixes of
    queries that start with a letter or digit; the ``limit`` heaviest."""
    starts = F.array(*[F.when(F.length("query") >= n, F.lower(F.substring("query", 1, n))) for n in lengths])
    per_query = catalog.where(F.col("query").rlike(pattern)).select("all_time_count", F.explode(starts).alias("p"))
    return (per_query.where(F.col("p").isNotNull()).groupBy("p").agg(F.sum("all_time_count").alias("w"))
            .orderBy(F.desc("w"), F.asc("p")).limit(limit))


def prefix_cdf(weights: DataFrame) -> DataFrame:
    """``(p, w, lo, cdf)``: running share over descending weights.  The input
    is the bounded top list, so a single-partition window is fine."""
    order = Window.orderBy(F.desc("w"), F.asc("p"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(1))
    acc = F.sum("w").over(run)
    tot = F.sum("w").over(total)
    return weights.select("p", "w", ((acc - F.col("w")) / tot).alias("lo"),
                          (acc / tot).alias("cdf"))


def weighted_sample(draws: DataFrame, cdf: DataFrame, u_col: str = "u",
                    n_buckets: int = 1024) -> DataFrame:
    """Inverse-CDF lookup: each uniform draw picks the first prefix whose cdf
    is >= the draw.  Range join on buckets of [0, 1]."""
    first = Window.orderBy(F.asc("lo"))
    iv = (cdf.withColumn("_first", F.row_number().over(first) == 1)
          .withColumn("lo", F.when(F.col("_first"), F.lit(-1.0)).otherwise(F.col("lo")))
          .withColumn("cdf", F.when(F.col("cdf") >= 1.0, F.lit(2.0)).otherwise(F.col("cdf")))
          .select("p", "lo", "cdf"))
    return interval_lookup(draws, u_col, iv, "lo", "cdf", unit_buckets(n_buckets)) \
        .drop("lo", "cdf")


def weights_json(weights: DataFrame) -> DataFrame:
    """One JSON document ``[{"p":..,"w":..}, ...]`` ordered by weight desc
    (the list is bounded by the prefix limit)."""
    items = F.collect_list(F.struct("p", "w"))
    ordered = F.array_sort(items, lambda a, b: F.when(a["w"] > b["w"], -1)
                           .when(a["w"] < b["w"], 1)
                           .when(a["p"] < b["p"], -1)
                           .when(a["p"] > b["p"], 1).otherwise(0))
    return weights.agg(F.to_json(ordered).alias("prefixes_json"))
