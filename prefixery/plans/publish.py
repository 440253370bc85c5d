"""Rebuild and publish index generations; the offline catalog load.

A generation is an immutable folder ``index/gen=<n>`` (flat rows) plus
``lists/gen=<n>`` (one nested list per prefix, bucketed and sorted by prefix: a join
needs no exchange of the lists, one prefix is one bucket); it becomes current
only when its pointer record ``pointers/gen=<n>`` is written, after the
index data is complete.  Readers take the highest generation that has a
pointer, so a crashed rebuild is never visible and generations stay
monotone across restarts (they live with the data, not in a process).
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexParams, TOP_N
from ..operators import fold as fold_ops
from ..operators import prefix_index as px
from ..session import scratch_path
from ..sources import catalog_io

POINTER_SCHEMA = ("generation int, published_ms bigint, candidates bigint, nodes bigint, "
                  "index_rows bigint, max_event_ms bigint, staleness_ms bigint")


def pointers(spark: SparkSession, root: str) -> DataFrame:
    cols = [c.split()[0] for c in POINTER_SCHEMA.split(", ")]
    try:
        return spark.read.schema(POINTER_SCHEMA).json(f"{root}/pointers").select(*cols)
    except AnalysisException:          # nothing published yet
        return spark.createDataFrame([], POINTER_SCHEMA)


def current_generation(spark: SparkSession, root: str) -> int:
    """Highest published generation (0 when none); one row per generation."""
    r = pointers(spark, root).agg(F.max("generation").alias("g")).collect()[0]["g"]
    return int(r or 0)


def read_index(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    g = generation or current_generation(spark, root)
    return spark.read.parquet(f"{root}/index/gen={g}")


def _table_name(root: str, generation: int) -> str:
    return f"prefixery_lists_{hashlib.md5(root.encode()).hexdigest()[:16]}_g{generation}"


def _write_lists(spark: SparkSession, root: str, generation: int, lists: DataFrame, buckets: int) -> None:
    """Bucketed by prefix, one file per bucket; the number of buckets is recorded, so
    that a later session can name the table again."""
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("errorifexists").json(f"{root}/buckets/gen={generation}")
    (lists.repartition(buckets, "prefix").write.mode("errorifexists").bucketBy(buckets, "prefix").sortBy("prefix")
     .option("path", f"{root}/lists/gen={generation}").saveAsTable(_table_name(root, generation)))


def read_lists(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """The nested serving form ``(prefix, suggestions)`` of a generation, as a bucketed
    table: joined by prefix, only the other side is shuffled."""
    g = generation or current_generation(spark, root)
    name = _table_name(root, g)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.schema("buckets int").json(f"{root}/buckets/gen={g}").first()["buckets"]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (prefix STRING, suggestions ARRAY<STRUCT<query: STRING, score: DOUBLE>>) "
                  f"USING parquet CLUSTERED BY (prefix) SORTED BY (prefix) INTO {buckets} BUCKETS LOCATION '{root}/lists/gen={g}'")
    return spark.table(name)


def lookup_published(spark: SparkSession, root: str, prefix: str, generation: int | None = None) -> DataFrame:
    """Ranked list of one (normalised) prefix, from the one bucket that can hold it;
    empty when there is no such prefix."""
    one = read_lists(spark, root, generation).where(F.col("prefix") == F.lit(prefix))
    return (one.select("prefix", F.posexplode("suggestions").alias("_k", "_s"))
            .select("prefix", (F.col("_k") + 1).alias("rank"), "_s.query", "_s.score"))


def publish(spark: SparkSession, root: str, catalog: DataFrame, published_ms: int,
            params: IndexParams = IndexParams(), partitions: int | None = None) -> int:
    """Cut, score and rank ``catalog`` into a new generation; returns it.

    The index is written range partitioned and sorted on ``prefix`` (a lookup
    of one prefix reads one file range).  Staleness = publish time minus the
    newest event folded into the catalog."""
    gen = current_generation(spark, root) + 1
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch_path(spark, "publish-catalog")        # the catalog is computed once
    catalog.write.parquet(stored)
    catalog = spark.read.schema(catalog.schema).parquet(stored)
    cands = px.candidates(catalog, params)
    index = px.build_index(cands, params.k, params.max_prefix_len)
    (index.repartitionByRange(n, "prefix").sortWithinPartitions("prefix", "rank")
     .write.mode("errorifexists").parquet(f"{root}/index/gen={gen}"))     # of two rebuilds at once, one fails
    written = spark.read.parquet(f"{root}/index/gen={gen}")
    # Nested lists once per generation, so lookups and exports need no regrouping.
    _write_lists(spark, root, gen, px.nested_index(written), n)
    stats = px.index_stats(cands, written)
    newest = catalog.agg(F.max("last_ms").alias("max_event_ms"))
    nul = F.lit(None).cast("bigint")
    row = (stats.select("*", nul.alias("max_event_ms"))
           .unionByName(newest.select(nul.alias("candidates"), nul.alias("nodes"),
                                      nul.alias("index_rows"), "max_event_ms"))
           .agg(*[F.max(c).alias(c) for c in ("candidates", "nodes", "index_rows", "max_event_ms")]))
    ptr = row.select(F.lit(gen).alias("generation"), F.lit(published_ms).alias("published_ms"),
                     "candidates", "nodes", "index_rows", "max_event_ms",
                     (F.lit(published_ms) - F.col("max_event_ms")).alias("staleness_ms"))
    ptr.coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/gen={gen}")
    return gen


def load_catalog(spark: SparkSession, log: DataFrame, out_path: str, top_n: int = TOP_N,
                 csv_path: str | None = None) -> DataFrame:
    """Offline load: fold the raw log, keep the top N, write the base snapshot
    (and optionally the header CSV hand-off); returns the summary row."""
    top = fold_ops.catalog_top_n(fold_ops.fold_query_log(log), top_n)
    if csv_path:
        catalog_io.write_folded_csv(top, csv_path)
    catalog_io.write_snapshot(fold_ops.to_catalog(top), out_path)
    snap = catalog_io.read_snapshot(spark, out_path)
    return fold_ops.catalog_summary(snap, "all_time_count")


def read_query_log(spark: SparkSession, glob: str) -> DataFrame:
    """Multi-file Parquet scan of a raw query log, only the two folded columns."""
    return spark.read.parquet(glob).select("final_search_term", "popularity")
