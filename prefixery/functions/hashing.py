"""Deterministic hashes used for ring placement, draws and TTL jitter.

All are derived from md5 so that an independent SQL engine can reproduce
them bit for bit, and so that a retried task computes the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KEY_PREFIX, TTL_BASE_S, TTL_JITTER_S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash60(c) -> Column:
    """First 15 hex digits of md5(c) as a non-negative BIGINT in [0, 2**60)."""
    return F.conv(F.substring(F.md5(_c(c).cast("string")), 1, 15), 16, 10).cast("bigint")


def unit_draw(c) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of md5(c)."""
    h = F.conv(F.substring(F.md5(_c(c).cast("string")), 1, 13), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(float(2 ** 52))


def ttl_with_jitter(key, base: int = TTL_BASE_S, jitter: int = TTL_JITTER_S) -> Column:
    """base + an integer in [0, jitter], stable for a given key."""
    return (F.lit(base) + F.pmod(hash60(key), F.lit(jitter + 1))).cast("int")


def storage_key(generation, prefix) -> Column:
    return F.concat(F.lit(KEY_PREFIX), _c(generation).cast("string"), F.lit(":"), _c(prefix))
