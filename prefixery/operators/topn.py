"""Exact global top-N by a total order, for any N.

Spark's own ``orderBy().limit(n)`` merges n rows of every task in one task,
which the fold's million rows outgrow.  Here the rows are range partitioned on
the order and stored, so that the counts and the rows see the same bounds; the
partitions before row N pass whole, and only the one that straddles it is
ranked.  One count per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_n(df: DataFrame, n: int, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order`` (which must be a total order)."""
    if n <= 0:
        return df.limit(0)
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = _stored(df.repartitionByRange(p, *order).withColumn("_pid", F.spark_partition_id()), "topn")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).orderBy("_pid").collect()
    start = 0
    for r in sizes:
        if start + r["_n"] > n:
            break
        start += r["_n"]
    else:                                  # everything fits
        return ranged.select(*df.columns)
    edge = r["_pid"]
    part = (ranged.where(F.col("_pid") == edge)
            .withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
            .where(F.col("_r") <= n - start))
    return ranged.where(F.col("_pid") < edge).unionByName(part.drop("_r")).select(*df.columns)


TIE_LENGTHS = (2, 5, 10, 20)


def _crossing(rows: DataFrame, value: Column, keep: list[str]) -> DataFrame:
    """One row: the least ``value`` up to which there are ``_need`` rows (the same in
    every row, as are the ``keep`` columns), and how many rows of that value it takes; no
    row if there are fewer.  The window runs over one row per value."""
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (rows.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_need", *keep)])
               .withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") >= F.col("_need")))
    last = F.struct("_v", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), *keep)
    return counted.agg(F.min_by(last, "_upto").alias("s")).where("s IS NOT NULL").select("s.*")


def top_n_by_count(df: DataFrame, n: int, count_col: str, tie_col: str) -> DataFrame:
    """Exact top-``n`` by ``count_col`` desc (nulls last), ``tie_col`` asc, as one
    filter; no job runs and nothing is written while it is made.

    A scalar subquery finds the last row that passes.  Its count comes from the number
    of rows of each count value (at most sqrt(2 * sum(count)) values).  Among the rows
    tied at it the last tie value is narrowed down by its first 2, 5, 10 and 20
    characters: each step counts the rows under the characters found before, and only
    what shares 20 characters is ordered whole."""
    if n <= 0:
        return df.limit(0)
    c = F.col(count_col)
    rows = df.select(F.struct(c.isNull().alias("none"), (-c).alias("c")).alias("_c"), F.col(tie_col).alias("_t"))
    at = _crossing(rows.withColumn("_need", F.lit(n).cast("long")), F.col("_c"), []).withColumnRenamed("_v", "_at")
    for length in TIE_LENGTHS:
        own = rows.join(F.broadcast(at), [F.col("_c") == F.col("_at"), *([F.substring("_t", 1, at_length) == F.col("_head")]
                                                                        if length != TIE_LENGTHS[0] else [])])
        at = (_crossing(own, F.substring("_t", 1, length), ["_at"])).withColumnRenamed("_v", "_head")
        at_length = length
    own = rows.join(F.broadcast(at), [F.col("_c") == F.col("_at"), F.substring("_t", 1, at_length) == F.col("_head")])
    last = _crossing(own, F.col("_t"), ["_at"]).select(F.struct("_at.none", "_at.c", F.col("_v").alias("t")).alias("last"))
    own_key = F.struct(c.isNull().alias("none"), (-c).alias("c"), F.col(tie_col).alias("t"))
    return df.where(F.coalesce(own_key <= last.scalar(), F.lit(True)))
