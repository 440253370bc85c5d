"""Quality rules: n-gram perplexity bands beside fixed base rules.

A modified Kneser-Ney model over byte n-grams is counted per language by Spark.
The counts of the highest order come from the texts (combined on the map side);
continuation counts, context totals, discounts and interpolated probabilities
are grouped sums and equi-joins over the distinct grams.  All orders are stored
as sorted hash arrays of log10 probabilities and back-off weights; a text's
perplexity is 10 ** (-log10 p / bytes) of its word stream.

Each language's band spans ``spread`` interquartile ranges beyond the quartiles
of log10 perplexity (a histogram of width ``STEP`` over all distinct texts that
pass the base rules, so the quartiles are exact to that step); documents outside
it are rejected.  Texts with the same least hash of their ``SKETCH``-word windows
(near copies do, as likely as their windows are alike) weigh as much as one text
together, and the model counts a repeated text once however many rows have it, so
that no group of copies sets the band.  Every row is scored.

While the model holds at most ``broadcast_rows`` rows (28 bytes each) its arrays
go to every task, in pieces (``shared_arrays``); beyond that the documents' gram counts are joined to its
highest order, which holds every gram of the texts it was counted on.

Defined results: a null text is empty; texts without words fail the base rules
(n_words < 50).  A null language is a language of its own (the empty string).
Repeated rows each get a row.  A language in which no document
passes the base rules has no band; its documents have failed anyway.  Columns
other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Counter, HashArrays, grams, mix, signed, slices, stream, sums, window_hashes, windows
from .common import by_arrow, packed_suffix, stored, table
from .shared_arrays import shared_arrays

ORDER = 5
BROADCAST_ROWS = 6_000_000
MAX_LANGUAGES = 1 << 16     # they are numbered in 16 bits of the keys
STEP = 0.001
MIN_WORDS = 50
REPEAT_WINDOW = 3
SKETCH = 5
BROADCAST_MARKS = 500_000   # repeated texts' hashes sent to all tasks, more are joined by shuffle
SYMBOLS = "#*$%&|<>"
_ROWS = 1 << 17

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


# ---------------------------------------------------------------- base rules

def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words per row inside windows that occur twice or more in the row."""
    at, row = windows(first, REPEAT_WINDOW)
    key = mix(window_hashes(h, at, REPEAT_WINDOW) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1] if len(ordered) else np.zeros(0, bool)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), np.int64)
    for k in range(REPEAT_WINDOW):
        covered[at[twice] + k] = 1
    return sums(covered, first)


def _repeated_lines(s, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the row."""
    starts, ends, first = s.segments(_NEWLINE)
    has_word = np.searchsorted(word_starts, starts) < np.searchsorted(word_starts, ends)
    row = np.repeat(np.arange(s.n), np.diff(first))[has_word]
    h = s.hashes(starts[has_word], ends[has_word]) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, kept = np.unique(mix(h), return_index=True)
    again = np.ones(len(h), np.int64)
    again[kept] = 0
    return np.bincount(row, again, s.n).astype(np.int64)


def _sketch(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least hash of the word windows of each row (0 without any)."""
    at, row = windows(first, SKETCH)
    out = np.zeros(len(first) - 1, np.uint64)
    if len(at):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[start]] = np.minimum.reduceat(mix(window_hashes(h, at, SKETCH)), start)
    return signed(out)


def _base(s) -> list[np.ndarray]:
    starts, ends, first = s.words()
    inside = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[s.buf])])
    n = np.diff(first)
    h = s.hashes(starts, ends)
    return [n, sums(inside[ends] - inside[starts], first), symbols[s.off[1:]] - symbols[s.off[:-1]],
            _repeated_lines(s, starts), _repeats(h, first), _sketch(h, first)]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = [*BASE, "sketch"]


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


# ---------------------------------------------------------------- the model

def _languages(s) -> tuple[list[str], np.ndarray]:
    names, codes = np.unique(np.array([x or "" for x in s.column("lang").to_pylist()], dtype=object).astype(str),
                             return_inverse=True)
    return list(names), codes


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, g, c): counts of the highest order's grams."""
    def run(batches):
        found: dict[str, Counter] = {}
        for s in slices(batches):
            g, row = grams(*stream(s, order - 1), order)
            names, codes = _languages(s)
            code = np.repeat(codes, np.diff(row))
            for k, name in enumerate(names):
                found.setdefault(name, Counter()).add(g[code == k])
        for name, counter in found.items():
            g, c = counter.merge()
            for k in range(0, len(g), _ROWS):
                part = g[k:k + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part)), pa.array(part), pa.array(c[k:k + _ROWS])], ["lang", "g", "c"])

    local = by_arrow(docs.select("text", "lang"), run, "lang string, g long, c long")
    return local.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> DataFrame:
    """Per language (at most ``MAX_LANGUAGES`` rows): the discounts of counts 1, 2
    and 3 or more, from the counts of counts (1/2, 1, 3/2 where these are
    degenerate)."""
    n = level.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int):
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}"))
        return F.when((value > 0) & (value < k), value).otherwise(k / 2).alias(f"d{k}")

    return n.select("lang", d(1), d(2), d(3))


def _weighted(level: DataFrame) -> DataFrame:
    """Adds ``own`` (discounted estimate) and ``gamma`` (the context's weight of
    the lower order)."""
    level = level.join(F.broadcast(_discounts(level)), "lang").withColumn("ctx", F.shiftright("g", 8))
    level = level.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    totals = level.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
    return (level.join(totals, ["lang", "ctx"])
            .select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"),
                    (F.col("held") / F.col("total")).alias("gamma")))


def fit(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(ord, lang, g, p, gamma): interpolated probability of each gram's last
    byte, and the back-off weight of its context, for orders 1..order."""
    levels = {order: stored(gram_counts(docs, order), "kn-counts")}
    if levels[order].select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for k in range(order - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy("lang", packed_suffix(F.col("g"), k).alias("g"))
                           .agg(F.count("*").alias("c")), f"kn-continuations{k}")
    out = None
    for k in range(1, order + 1):
        level = _weighted(levels[k])
        if k == 1:
            level = level.withColumn("p", F.col("own") + F.col("gamma") / 256.0)
        else:
            lower = out.select("lang", F.col("g").alias("low"), F.col("p").alias("p0"))
            level = (level.withColumn("low", packed_suffix(F.col("g"), k - 1)).join(lower, ["lang", "low"])
                     .withColumn("p", F.col("own") + F.col("gamma") * F.col("p0")))
        out = stored(level.select(F.lit(k).alias("ord"), "lang", "g", "p", "gamma"), f"kn-order{k}")
        levels[k] = out
    model = levels[1]
    for k in range(2, order + 1):
        model = model.unionByName(levels[k])
    return model


def _key(order: int, lang: int, g: np.ndarray) -> np.ndarray:
    return g | np.int64(lang << 40) | np.int64(order << 56)


def _prefixes(rows: pa.RecordBatch | pa.Table, lang: dict[str, int]) -> np.ndarray:
    """The language's and the order's bits of the rows' keys."""
    names = rows.column("lang")
    names = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).dictionary_encode()
    code = np.array([lang[x] for x in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices)]
    return (code << 40) | (np.asarray(rows.column("ord")).astype(np.int64) << 56)


def _gram_entries(rows: pa.RecordBatch | pa.Table, lang: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(rows.column("g")) | _prefixes(rows, lang), np.log10(np.asarray(rows.column("p")))


def _context_entries(rows: pa.RecordBatch | pa.Table, lang: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Once for every gram of the context."""
    return (np.asarray(rows.column("g")) >> 8) | _prefixes(rows, lang), np.log10(np.asarray(rows.column("gamma")))


class SortedModel:
    """All orders in two tables of hash arrays: probabilities by gram, back-off
    weights by context.  Languages are numbered in the key (16 bits), orders up to 5."""

    def __init__(self, rows: pa.Table, order: int):
        """Of a model's rows in this process."""
        self.order = order
        self.lang = {name: k for k, name in enumerate(rows.column("lang").unique().to_pylist())}
        self.grams = HashArrays(*_gram_entries(rows, self.lang))
        context, gamma = _context_entries(rows, self.lang)
        context, one = np.unique(context, return_index=True)
        self.contexts = HashArrays(context, gamma[one])

    @classmethod
    def shared(cls, model: DataFrame, order: int) -> SortedModel:
        """For all tasks; the rows do not meet in one process before."""
        self = cls.__new__(cls)
        self.order = order
        names = model.select("lang").distinct().collect()           # at most ``MAX_LANGUAGES``
        self.lang = lang = {r["lang"]: k for k, r in enumerate(names)}
        self.grams = shared_arrays(model.select("ord", "lang", "g", "p"), lambda rows: _gram_entries(rows, lang),
                                   np.float64, "kn-grams")
        self.contexts = shared_arrays(model.select("ord", "lang", "g", "gamma"), lambda rows: _context_entries(rows, lang),
                                      np.float64, "kn-contexts")
        return self

    def logp(self, lang: str, g: np.ndarray) -> np.ndarray:
        """log10 probabilities of grams of the highest order; a gram that the
        model lacks backs off through the weights of its known contexts."""
        out = np.zeros(len(g))
        code = self.lang.get(lang)
        left = np.arange(len(g))
        for k in range(self.order, 0, -1) if code is not None else ():
            own = g[left] & ((1 << (8 * k)) - 1)
            known, value = self.grams.look(_key(k, code, own))
            out[left[known]] += value[known]
            left, own = left[~known], own[~known]
            if not len(left):
                return out
            _, value = self.contexts.look(_key(k, code, own >> 8))
            out[left] += value
        out[left] += np.log10(1 / 256)
        return out


# ---------------------------------------------------------------- scoring

_SCORED = "doc_id long, mark long, lang string, " + ", ".join(f"{c} long" for c in _MEASURED) + ", base_failed boolean, logp double, n_bytes long"


def _by_arrays(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    kn = SortedModel.shared(model, order)

    def run(batches):
        for s in slices(batches):
            base = _base(s)
            g, row = grams(*stream(s, order - 1), order)
            names, codes = _languages(s)
            code, logp = np.repeat(codes, np.diff(row)), np.zeros(len(g))
            for k, name in enumerate(names):
                mine = code == k
                logp[mine] = kn.logp(name, g[mine])
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").cast(pa.int64()), s.column("mark"), pa.array([names[k] for k in codes], pa.string()), *map(pa.array, base),
                 pa.array(base_failed(base[0], base[4])), pa.array(sums(logp, row)), pa.array(np.diff(row))],
                ["doc_id", "mark", "lang", *_MEASURED, "base_failed", "logp", "n_bytes"])

    return by_arrow(docs, run, _SCORED)


def _by_join(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    def run(batches):
        for s in slices(batches):
            base = _base(s)
            failed = base_failed(base[0], base[4])
            g, row = grams(*stream(s, order - 1), order)
            names, codes = _languages(s)
            line = np.asarray(s.column("line"))
            for r in range(s.n):
                u, m = np.unique(g[row[r]:row[r + 1]], return_counts=True)
                size = len(u)
                same = s.rows.slice(r, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, line[r])), pa.concat_arrays([same.column(0).cast(pa.int64())] * size),
                     pa.concat_arrays([same.column(3)] * size), pa.array([names[codes[r]]] * size, pa.string()),
                     *[pa.array(np.full(size, b[r])) for b in base], pa.array(np.full(size, failed[r])),
                     pa.array(u), pa.array(m)], ["line", "doc_id", "mark", "lang", *_MEASURED, "base_failed", "g", "n"])

    schema = "line long, doc_id long, mark long, lang string, " + ", ".join(f"{c} long" for c in _MEASURED) + ", base_failed boolean, g long, n long"
    own = by_arrow(docs.withColumn("line", F.monotonically_increasing_id()), run, schema)
    top = model.where(F.col("ord") == order).select("lang", "g", F.log10("p").alias("lp"))
    return (own.join(top, ["lang", "g"]).groupBy("line", "doc_id", "mark", "lang", *_MEASURED, "base_failed")
            .agg(F.sum(F.col("n") * F.col("lp")).alias("logp"), F.sum("n").alias("n_bytes")).drop("line"))


def bands(scored: DataFrame, spread: float, least: float) -> DataFrame:
    """(lang, lower, upper) of log10 perplexity, over distinct texts; those of one
    sketch weigh one together."""
    texts = (scored.where(~F.col("base_failed")).groupBy("lang", "mark")
             .agg(F.min("sketch").alias("sketch"), F.min(F.round(F.col("log10_ppl") / STEP).cast("long")).alias("bin")))
    alike = texts.groupBy("lang", "sketch", "bin").count()              # a sketch has a row per bin, not per text
    share = F.col("count") / F.sum("count").over(Window.partitionBy("lang", "sketch"))
    histogram = alike.withColumn("share", share).groupBy("lang", "bin").agg(F.sum("share").alias("count"))
    upto = Window.partitionBy("lang").orderBy("bin")
    ranked = histogram.withColumn("upto", F.sum("count").over(upto)).withColumn(
        "all", F.sum("count").over(Window.partitionBy("lang")))
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * (p - 1e-9), F.col("bin"))) * STEP
    quartiles = ranked.groupBy("lang").agg(q(0.25).alias("q1"), q(0.75).alias("q3"))
    reach = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), F.lit(least))
    return quartiles.select("lang", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def rate(docs: DataFrame, order: int = ORDER, spread: float = 3.0, least: float = 0.03,
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept, lang,
    perplexity and its language's lower and upper bound."""
    return _rated(docs, order, spread, least, broadcast_rows).drop("mark")


def _mark(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"], F.coalesce(docs["lang"], F.lit("")))


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """(text, lang), once where several rows have both.  Only rows with copies are
    shuffled, one of each text per task."""
    again = stored(docs.groupBy("mark").count().where("count > 1").select("mark"), "rules-repeated")
    few = again.count() <= BROADCAST_MARKS
    known = F.broadcast(again) if few else again.hint("shuffle_hash")
    copied = docs.join(known, "mark", "left_semi").dropDuplicates(["mark"]).select("text", "lang")
    single = docs.join(known, "mark", "left_anti").select("text", "lang")
    return single.unionByName(copied)


def _rated(docs: DataFrame, order: int = ORDER, spread: float = 3.0, least: float = 0.03,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    if order > 5:
        raise ValueError("orders up to 5 fit the packed keys")
    docs = docs.select("doc_id", "text", "lang", _mark(docs).alias("mark"))
    model = fit(_distinct_texts(docs), order)
    scored = (_by_arrays if model.count() <= broadcast_rows else _by_join)(docs, model, order)
    scored = stored(scored.withColumn("log10_ppl", -F.col("logp") / F.col("n_bytes")), "kn-scored")
    inside = F.col("log10_ppl").between(F.col("lower"), F.col("upper"))
    return (scored.join(F.broadcast(bands(scored, spread, least)), "lang", "left")
            .select("doc_id", "mark", *BASE, "base_failed",
                    (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "lang",
                    F.pow(F.lit(10.0), "log10_ppl").alias("perplexity"),
                    F.pow(F.lit(10.0), "lower").alias("lower"), F.pow(F.lit(10.0), "upper").alias("upper")))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents whose rating is ``kept``, with their own columns (found by
    id and hash of text and language)."""
    bad = _rated(docs, **options).where("NOT kept").select(F.col("doc_id").alias("bad_id"), "mark").distinct()
    bad = stored(bad, "rules-rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (_mark(docs) == bad["mark"]),
                     "left_anti")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"))
