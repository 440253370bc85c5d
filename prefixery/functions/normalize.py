"""Query normalisation and predicates (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java String.strip(): leading/trailing Character.isWhitespace code points.
# No-break spaces (U+00A0, U+2007, U+202F) are not whitespace to Java and stay.
_STRIP = r"^\p{javaWhitespace}+|\p{javaWhitespace}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_unicode(c) -> Column:
    return F.regexp_replace(_c(c), _STRIP, "")


def normalize(c, mode: str = "read") -> Column:
    """Normalised query key.

    ``mode='read'`` is the request/ingest path: Unicode strip + lower case.
    ``mode='loader'`` is the offline fold: ASCII-space trim + lower case.
    """
    if mode == "read":
        return F.lower(strip_unicode(c))
    if mode == "loader":
        return F.lower(F.trim(_c(c)))
    raise ValueError(f"unknown normalisation mode {mode!r}")


def is_blank(c) -> Column:
    """True for null or whitespace-only input (request short-circuit)."""
    return _c(c).isNull() | (F.length(strip_unicode(c)) == 0)


def prefix_lengths(c, max_len: int | None = None) -> Column:
    """Array of the lengths of every prefix of ``c``, 0 included (code points)."""
    hi = F.length(_c(c))
    return F.sequence(F.lit(0), hi if max_len is None else F.least(hi, F.lit(max_len)))


def split_head(query, prefix) -> tuple[Column, Column]:
    q, p = _c(query), _c(prefix)
    n = F.length(p)
    hit = F.lower(q).startswith(F.lower(p))
    head = F.when(hit, F.substring(q, F.lit(1), n))
    tail = F.when(hit, F.substring(q, n + 1, F.length(q)))
    return head, tail
