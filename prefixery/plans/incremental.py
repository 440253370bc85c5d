"""Incremental rebuild of the prefix index.

Candidates and lists are range stores (``sources.range_store``), keyed by query and
by prefix.  A change of some queries' scores touches only the prefixes of these
queries.  A touched list is ranked again from what it held, without the changed
queries, and their new scores.  That is the whole answer if the list was not full, or
if its first K entries rank no lower than its old last entry: what the list did not
hold ranks below that.  The other prefixes (a query dropped out or fell) are filled
from a range scan of the new candidates.  Slots without touched prefixes are carried
into the next generation by reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IndexParams
from ..operators import prefix_index as px
from ..session import scratch_path
from ..sources import range_store as rs

CANDS = "query string, score double"
LISTS = "prefix string, suggestions array<struct<query:string,score:double>>"


def create_index(spark: SparkSession, root: str, cands: DataFrame, params: IndexParams = IndexParams(),
                 slots: int | None = None) -> None:
    """First generation of candidates and lists."""
    rs.create(spark, f"{root}/cands", cands.select("query", "score"), "query", slots)
    stored = rs.read(spark, f"{root}/cands", CANDS)
    rs.create(spark, f"{root}/lists", px.nested_index(px.build_index(stored, params.k, params.max_prefix_len)), "prefix", slots)


def read_lists(spark: SparkSession, root: str, gen: int | None = None) -> DataFrame:
    return rs.read(spark, f"{root}/lists", LISTS, gen)


def candidate_changes(spark: SparkSession, root: str, cands: DataFrame) -> DataFrame:
    """(query, score) of the candidates that are new or have another score; a null
    score where one is gone."""
    old = rs.read(spark, f"{root}/cands", CANDS).withColumnRenamed("score", "was")
    both = cands.select("query", "score").join(old, "query", "full_outer")
    return both.where(~F.col("score").eqNullSafe(F.col("was"))).select("query", "score")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replaced(key: str, value: str):
    """Rows with the changes' values; a null value removes the key."""
    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        new = changes.where(F.col(value).isNotNull()).select(*rows.columns)
        return rows.join(changes.select(key), key, "left_anti").unionByName(new)

    return merge


def update_index(spark: SparkSession, root: str, changes: DataFrame, params: IndexParams = IndexParams()) -> int:
    """Apply ``changes`` (query, score or null) and publish the next generation of
    lists; returns it."""
    k = params.k
    changes = _stored(changes.select("query", "score"), "index-changes")
    rs.rewrite(spark, f"{root}/cands", "query", CANDS, changes, _replaced("query", "score"))
    entering = _stored(px.explode_prefixes(changes, params.max_prefix_len), "index-entering")
    touched = _stored(entering.select("prefix").distinct(), "index-touched")
    slots = rs.manifest(spark, f"{root}/lists")
    numbers = sorted(r["slot"] for r in touched.select(rs.router(slots)(F.col("prefix")).alias("slot")).distinct().collect()) if slots else []
    old = rs.read(spark, f"{root}/lists", LISTS, only=numbers).join(touched, "prefix", "left_semi")
    last = F.element_at("suggestions", -1)
    full = F.size("suggestions") >= k
    old = _stored(old.select("prefix", "suggestions", F.when(full, last["query"]).alias("last_query"),
                             F.when(full, last["score"]).alias("last_score")), "index-old")
    kept = (old.select("prefix", F.explode("suggestions").alias("s")).select("prefix", "s.query", "s.score")
            .join(changes.select("query"), "query", "left_anti").select("prefix", "query", "score"))
    known = kept.unionByName(entering.where("score IS NOT NULL").select("prefix", "query", "score"))
    best = Window.partitionBy("prefix").orderBy(F.desc("score"), F.asc("query"))
    ranked = known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    lists = _stored(px.nested_index(ranked), "index-lists")
    # a list that was full must be full again, with nothing below its old last entry
    end = F.element_at("suggestions", -1)
    sure = (F.size("suggestions") >= k) & ((end["score"] > F.col("last_score"))
                                           | ((end["score"] == F.col("last_score")) & (end["query"] <= F.col("last_query"))))
    state = touched.join(lists, "prefix", "left").join(old.select("prefix", "last_query", "last_score"), "prefix", "left")
    short = F.col("last_query").isNotNull() & ~F.coalesce(sure, F.lit(False))
    fill = _stored(state.where(short).select("prefix"), "index-fill")
    scanned = (rs.scan_prefixes(spark, f"{root}/cands", "query", CANDS, fill)
               .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    new = (state.where(~short).select("prefix", "suggestions")
           .unionByName(fill.join(px.nested_index(scanned), "prefix", "left").select("prefix", "suggestions")))
    return rs.rewrite(spark, f"{root}/lists", "prefix", LISTS, new, _replaced("prefix", "suggestions"))


REFRESH_SCHEMA = "published_ms bigint, changed bigint, max_event_ms bigint, staleness_ms bigint"


def refresh(spark: SparkSession, root: str, catalog: DataFrame, published_ms: int, params: IndexParams = IndexParams(),
            slots: int | None = None) -> dict:
    """Bring the index in key ranges to the state of ``catalog``: all of it the first
    time, after that only what has changed.  Records and returns the generation of the
    lists, the number of changed candidates and the staleness."""
    stored = _stored(catalog.select("query", "all_time_count", "recent_score", "last_ms"), "refresh-catalog")
    cands = _stored(px.candidates(stored, params), "refresh-candidates")
    if not rs.generation(spark, f"{root}/lists"):
        create_index(spark, root, cands, params, slots)
        changed, gen = cands.count(), rs.generation(spark, f"{root}/lists")
    else:
        changes = _stored(candidate_changes(spark, root, cands), "refresh-changes")
        changed, gen = changes.count(), update_index(spark, root, changes, params)
    newest = stored.agg(F.max("last_ms")).first()[0]
    row = (published_ms, changed, newest, None if newest is None else published_ms - newest)
    (spark.createDataFrame([row], REFRESH_SCHEMA).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").json(f"{root}/refreshes/gen={gen}/at={published_ms}"))
    return {"generation": gen, **dict(zip([c.split()[0] for c in REFRESH_SCHEMA.split(", ")], row, strict=True))}
