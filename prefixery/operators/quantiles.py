"""Exact continuous quantiles from value counts.

``quantile_cont(p)`` of ``n`` values is the interpolation between the values
at 0-based ranks ``floor((n-1)p)`` and ``ceil((n-1)p)``.  Equal values are
counted first (combined on the map side, so a frequent value is one row), the
counts are range partitioned on ``(group, value)`` and stored; running counts
within a partition plus those of the partitions before give every value its
ranks.  No task holds a whole group, and nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topn import _stored


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n)``, null values skipped."""
    return (df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
            .where(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(counts: DataFrame, group: str, probs, partitions: int | None = None) -> DataFrame:
    """``(group, n, q0, q1, ...)`` from ``value_counts``: one quantile per
    probability."""
    spark = counts.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = _stored(counts.repartitionByRange(p, "_g", "_v").withColumn("_pid", F.spark_partition_id()), "quantiles")
    sizes = ranged.groupBy("_g", "_pid").agg(F.sum("_n").alias("_size"))
    own = Window.partitionBy("_g").orderBy("_pid")
    sizes = sizes.select("_g", "_pid",
                         (F.sum("_size").over(own) - F.col("_size")).alias("_before"),
                         F.sum("_size").over(Window.partitionBy("_g")).alias("n"))
    inside = Window.partitionBy("_g", "_pid").orderBy("_v")
    ranked = ranged.join(sizes, ["_g", "_pid"]).withColumn("_hi", F.col("_before") + F.sum("_n").over(inside))

    def at(rank):          # the value at a 0-based rank
        return F.max(F.when((rank >= F.col("_hi") - F.col("_n")) & (rank < F.col("_hi")), F.col("_v")))

    out = []
    for k, prob in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(prob))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        out.append((low * (1 - share) + high * share).alias(f"q{k}"))
    return ranked.groupBy("_g").agg(F.max("n").alias("n"), *out).withColumnRenamed("_g", group)
