"""Secret scan: fixed patterns plus sliding-window entropy, in SQL functions only.

Base kinds, leftmost and non-overlapping within a kind: ``assign`` (a keyword, a
separator and a value of 6 or more characters), ``access`` (AKIA and capitals or
digits, 20 or more characters in all) and ``hex`` (24 or more).  A span is that
of the whole match, in code points, end exclusive.

Method: candidate strings are the maximal runs of a character class, at least
one window long.  A window of ``WINDOW`` characters slides over a candidate; the
count of the entering and of the leaving character are adjusted, and with them
the running sum of c log2 c, so that the entropy log2 W - sum / W of each window
costs one step.  The hull of the windows at or above the class's threshold is a
span, unless the allow-list suppresses the candidate or the span overlaps an
earlier one (base spans first, then ``entropy_hex``, then ``entropy_base64``).

Allow-list: a candidate that is a UUID or a date as a whole; one whose longest part
between ``= / _ -`` bears a word of documentation values; and one that has, beside
plain numbers and words (one case, capitalised, or camel case), less than ``REST``
characters in its parts.  So neither a name nor a date beside a key hides it.

Every step is an expression of one row: no shuffle, and no state beyond a text.

Defined results: a null text is empty; a text without findings has counts 0, the
SHA-256 of the empty string and empty ``spans``.  A null doc_id stays null.
Repeated rows are scanned each.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"        # a shorter run has no longer one inside: same as matching, then dropping
HEX = r"[0-9a-f]{24,}"               # likewise
WINDOW = 20
# class: (name, alphabet, candidate, least entropy in bits)
CLASSES = [
    ("entropy_hex", "0123456789abcdefABCDEF", r"[0-9a-fA-F]{20,}", 3.05),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
     r"[A-Za-z0-9+/=_-]{20,}", 3.9),
]
REST = 16                  # characters that no word or number explains
SEPARATOR = "[=/_-]+"
# The allow-list.
ALLOW_WHOLE = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9-]*)?$",           # dates
]
ALLOW_LONGEST = [r"(?i)example|sample|placeholder|dummy|xxxx"]                 # documentation values
ALLOW_PART = [r"^[0-9]+$", r"^[A-Z]+$", r"^[A-Z]?[a-z]*([A-Z][a-z]+)*$"]       # numbers and words
ALLOW = {"whole": ALLOW_WHOLE, "longest": ALLOW_LONGEST, "part": ALLOW_PART}
KINDS = ["assign", "access", "hex"] + [c[0] for c in CLASSES]

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _matches(text: Column, pattern: str, kind: str, value: int | None = None, least: int = 0) -> Column:
    """All matches with their spans; with ``value``, those whose group of this
    number has at least ``least`` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    each = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("gap"), sizes.alias("v"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["m"].alias("text"))
        out = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    walked = F.aggregate(each, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), walked).otherwise(_none())


def _x_log_x(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)


def _hull(candidate: Column, alphabet: str, window: int, least: float) -> Column:
    """struct(lo, hi): first and last character (end exclusive) of the windows
    whose entropy is at least ``least``; lo is -1 if there is none."""
    symbols = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def step(acc, i):
        enter = F.element_at(acc["symbols"], i + 1)
        leave = F.when(i >= window, F.element_at(acc["symbols"], F.greatest(i - window + 1, F.lit(1)))).otherwise(-1)
        old = F.element_at(acc["counts"], enter + 1)
        grown = acc["sum"] + _x_log_x(old + 1) - _x_log_x(old)
        gone = F.element_at(acc["counts"], F.greatest(leave, F.lit(0)) + 1) + (leave == enter).cast("int")
        total = F.when(leave >= 0, grown + _x_log_x(gone - 1) - _x_log_x(gone)).otherwise(grown)
        counts = F.transform(acc["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
        high = (i >= window - 1) & (math.log2(window) - total / window >= least)
        return F.struct(acc["symbols"].alias("symbols"), counts.alias("counts"), total.alias("sum"),
                        F.when(high & (acc["lo"] < 0), i - (window - 1)).otherwise(acc["lo"]).alias("lo"),
                        F.when(high, i + 1).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(symbols.alias("symbols"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
                     F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, step,
                       lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))


def _any(text: Column, patterns: list[str]) -> Column:
    known = F.lit(False)
    for p in patterns:
        known = known | text.rlike(p)
    return known


def _entropy(text: Column, kind: str, alphabet: str, pattern: str, least: float, window: int, allow: dict[str, list[str]]) -> Column:
    def suspicious(x):
        parts = F.split(x["text"], SEPARATOR)
        longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
        rest = F.aggregate(F.filter(parts, lambda p: ~_any(p, allow["part"])), F.lit(0), lambda acc, p: acc + F.length(p))
        return ~_any(x["text"], allow["whole"]) & ~_any(longest, allow["longest"]) & (rest >= REST)

    def narrowed(x):
        hull = _hull(x["text"], alphabet, window, least)
        return F.transform(F.array(hull), lambda h: F.struct(
            (x["start"] + h["lo"]).alias("start"), x["rank"].alias("rank"),
            F.when(h["lo"] >= 0, x["start"] + h["hi"]).otherwise(-1).alias("end"),
            x["kind"].alias("kind"),
            F.substring(x["text"], h["lo"] + 1, h["hi"] - h["lo"]).alias("text")))[0]

    spans = F.filter(_matches(text, pattern, kind), suspicious)
    return F.filter(F.transform(spans, narrowed), lambda x: x["end"] > x["start"])


def _without(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, window: int = WINDOW, classes=None, allow: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``found`` (spans as structs
    start, rank, end, kind, text; sorted by start, then kind)."""
    classes, allow = classes or CLASSES, ALLOW if allow is None else allow
    text = F.col("body")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).select(
        "doc_id", "body", _matches(text, ASSIGN, "assign", 2, 6).alias("a"),
        _matches(text, ACCESS, "access").alias("b"), _matches(text, HEX, "hex").alias("c"))
    out = out.select("doc_id", "body", F.array_sort(F.concat("a", "b", "c")).alias("base"))
    out = out.withColumn("found", F.col("base"))
    for name, alphabet, pattern, least in classes:
        more = _entropy(text, name, alphabet, pattern, least, window, allow)
        out = out.withColumn("more", more).withColumn(
            "found", F.concat("found", _without(F.col("more"), F.col("found")))).drop("more")
    return out.select("doc_id", "base", F.array_sort("found").alias("found"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"),
                        (F.size("found") - F.size("base")).cast("long").alias("n_entropy"))
