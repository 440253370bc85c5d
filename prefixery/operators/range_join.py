"""Interval lookup as an equi join on buckets plus a residual range test.

Spark has no as-of / interval join; a plain non-equi join would be a
nested loop.  Each half-open interval ``(lo, hi]`` is exploded over the
coarse buckets it touches, so the lookup becomes a hash join on the bucket
with ``lo < v <= hi`` as the residual.  Intervals must not overlap.  The
interval side has ``#intervals + #buckets`` rows; callers pass sides whose
size is bounded by configuration (ring points, a 300-row CDF) and broadcast
them explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_lookup(points: DataFrame, value: str, intervals: DataFrame,
                    lo: str, hi: str, bucket_of, how: str = "left") -> DataFrame:
    """Attach to each point the interval row with ``lo < value <= hi``.

    ``bucket_of(col) -> Column`` maps a value to a non-decreasing integer bucket.
    """
    exploded = intervals.withColumn(
        "_b", F.explode(F.sequence(bucket_of(F.col(lo)), bucket_of(F.col(hi)))))
    p = points.withColumn("_pb", bucket_of(F.col(value)))
    cond = ((p["_pb"] == exploded["_b"]) & (p[value] > exploded[lo]) & (p[value] <= exploded[hi]))
    return p.join(F.broadcast(exploded), cond, how).drop("_pb", "_b")


def high_bits(shift: int):
    """Bucket of a non-negative BIGINT: its bits above ``shift``."""
    def f(c: Column) -> Column:
        return F.shiftright(F.greatest(c, F.lit(0)), shift)
    return f


def unit_buckets(n: int):
    """Bucket of a double in [0, 1]: ``floor(v * n)`` clamped to [0, n]."""
    def f(c: Column) -> Column:
        return F.least(F.greatest(F.floor(c * F.lit(float(n))), F.lit(0)), F.lit(n)).cast("bigint")
    return f
