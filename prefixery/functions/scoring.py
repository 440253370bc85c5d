"""Scoring and time arithmetic (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WEIGHT_ALL_TIME, WEIGHT_RECENT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blended_score(count, recent=None, w_all_time: float = WEIGHT_ALL_TIME,
                  w_recent: float = WEIGHT_RECENT) -> Column:
    """w1 * log1p(all_time_count) + w2 * recent_score."""
    s = F.lit(w_all_time) * F.log1p(_c(count).cast("double"))
    if recent is not None:
        s = s + F.lit(w_recent) * F.coalesce(_c(recent).cast("double"), F.lit(0.0))
    return s


def epoch_millis(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column, independent of the session time zone."""
    return F.timestamp_diff("MILLISECOND",
                            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def to_epoch_ms(ts_text: str) -> int:
    """Python-side: epoch milliseconds of a UTC wall-clock text (for parameters)."""
    from datetime import datetime, timezone
    return int(datetime.fromisoformat(ts_text).replace(tzinfo=timezone.utc).timestamp() * 1000)
