"""Token counts attributed to sections through character offsets.

A document is encoded once, as a whole, with each token's span of code points.
Sections are intervals of the same text (``sections``: array of structs section,
start, end, ascending and disjoint); without that column the sections are the
lines, each with its newline.  The spans are interval-joined to the sections
within the document's own slice, by binary search in the sorted starts.

A token that crosses boundaries is allocated by ``rule``:

* ``first``: to the section that holds its first code point,
* ``last``: to the section that holds its last code point,
* ``most``: to the section that holds most of it, the earlier one on a tie,
* ``split``: to every section it touches, by its share of the token's length
  (what lies outside all sections is left over).

Tokens that no section takes are counted in a row with a null section, so that a
document's counts add up to its tokens (with ``split``: to rounding).

Defined results: a null or empty text has no tokens and, by lines, no section.
Sections with null bounds or end <= start hold nothing.  A null doc_id stays
null, repeated rows are counted each.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .chunk_encoder import default_vocabulary, encoder
from .common import small_batches, table

RULES = ("first", "last", "most", "split")
_OUT = "doc_id long, section string, start long, end long, n_tokens double, n_crossing long"


def _lines(s) -> tuple[list[str] | None, np.ndarray, np.ndarray, np.ndarray]:
    point = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
    breaks = np.flatnonzero(s.buf == 0x0A) + 1
    rows = s.off[:-1][np.diff(s.off) > 0]
    inner = breaks[~np.isin(breaks, s.off)]
    starts = np.union1d(rows, inner)
    ends = np.append(starts[1:], len(s.buf))[:len(starts)]
    first = np.searchsorted(starts, s.off)
    base = np.repeat(point[s.off[:-1]], np.diff(first))
    return None, point[starts] - base, point[ends] - base, first


def _given(s) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    names, starts, ends, first = [], [], [], [0]
    for row in s.column("sections").to_pylist():
        for x in sorted((x for x in row or () if x and x["start"] is not None and x["end"] is not None),
                        key=lambda x: x["start"]):
            if x["end"] > x["start"]:
                names.append(x["section"])
                starts.append(x["start"])
                ends.append(x["end"])
        first.append(len(names))
    return names, np.array(starts, np.int64), np.array(ends, np.int64), np.array(first)


def _joined(tokens, edge, starts, ends, first, rule: str, width: int):
    """Section index, share and whether it crosses, per allocated token.  Rows
    are set apart by ``width``, more than any text is long."""
    lo, hi = tokens
    row = np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * width
    own = np.repeat(np.arange(len(first) - 1), np.diff(first)) * width
    begin, finish = starts + own, ends + own
    lo, hi = lo + row, np.maximum(hi, lo + 1) + row
    a = np.searchsorted(finish, lo, "right")                  # the first section that ends after the token's start
    b = np.searchsorted(begin, hi, "left")                    # the first that begins at or after its end
    touched = np.maximum(b - a, 0)
    token = np.repeat(np.arange(len(lo)), touched)
    section = np.repeat(a, touched) + np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched)
    shared = np.minimum(finish[section], hi[token]) - np.maximum(begin[section], lo[token])
    crossing = np.zeros(len(lo), bool)
    if len(token):
        inside = np.bincount(token, shared, len(lo))
        crossing = (touched > 1) | ((touched > 0) & (inside < hi - lo))
    if rule == "split":
        return token, section, shared / (hi - lo)[token], crossing
    if rule == "first":
        take = begin[section] <= lo[token]
    elif rule == "last":
        take = finish[section] >= hi[token]
    else:
        order = np.lexsort((section, -shared, token))
        ahead = np.ones(len(order), bool)
        ahead[1:] = token[order][1:] != token[order][:-1]
        take = np.zeros(len(order), bool)
        take[order[ahead]] = True
    return token[take], section[take], np.ones(int(take.sum())), crossing


def attribute(docs: DataFrame, rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start, end, n_tokens,
    n_crossing (of the tokens it took, those that cross a boundary)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    given = "sections" in docs.columns

    def run(batches):
        coder = encoder(vocabulary, offsets=True)
        for s in slices(batches):
            (_, lo, hi), edge = coder.encode(s)
            names, starts, ends, first = (_given if given else _lines)(s)
            width = int(len(s.buf)) + 2 + int(ends.max() if len(ends) else 0)
            token, section, share, crossing = _joined((lo.astype(np.int64), hi.astype(np.int64)), edge, starts, ends, first, rule, width)
            total = np.bincount(section, share, len(starts)).astype(np.float64)      # without tokens it counts in integers
            crossed = np.bincount(section, crossing[token], len(starts)).astype(np.int64)
            row = np.repeat(np.arange(s.n), np.diff(first))
            left = np.diff(edge) - np.bincount(row, total, s.n)
            rest = np.flatnonzero(left > 1e-9)
            row = np.concatenate([row, rest])
            if names is None:
                names = np.char.add("line ", (np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first)) + 1).astype(str)).tolist()
            nulls = [None] * len(rest)
            out = pa.RecordBatch.from_arrays([
                s.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(names + nulls, pa.string()),
                pa.array(starts.tolist() + nulls, pa.int64()), pa.array(ends.tolist() + nulls, pa.int64()),
                pa.array(np.concatenate([total, left[rest]])), pa.array(np.concatenate([crossed, np.zeros(len(rest), np.int64)]))],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])
            yield out

    return small_batches(docs).select("doc_id", "text", *(["sections"] if given else [])).mapInArrow(run, _OUT)


def op9_token_attribution(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    out = attribute(table(spark, sf_dir, "documents"))
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
