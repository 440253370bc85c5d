"""Catalog sinks and sources: folded CSV, Parquet snapshots, JDBC candidate scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDED_CSV_SCHEMA = "q string, cnt bigint"
CATALOG_SCHEMA = "query string, all_time_count bigint, recent_score double, last_ms bigint"


# Keys may hold tabs, quotes and line breaks: everything is quoted, quotes are
# doubled, and no white space is trimmed on either side.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        "emptyValue": "", "lineSep": "\n"}


def write_folded_csv(top: DataFrame, path: str) -> str:
    """Folded catalog as header CSV ``q,cnt`` (the loader's hand-off format)."""
    top.select("q", "cnt").write.mode("overwrite").options(**_CSV, quoteAll=True).csv(path)
    return path


def read_folded_csv(spark: SparkSession, path: str) -> DataFrame:
    options = {k: v for k, v in _CSV.items() if k != "lineSep"}
    return spark.read.schema(FOLDED_CSV_SCHEMA).options(**options, multiLine=True).csv(path)


def write_snapshot(catalog: DataFrame, path: str, partitions: int | None = None) -> str:
    """Full-refresh snapshot, range partitioned and sorted on ``query`` so that
    Parquet min/max statistics make prefix predicates skip files and row groups."""
    n = partitions or int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (catalog.repartitionByRange(n, "query").sortWithinPartitions("query")
     .write.mode("overwrite").parquet(path))
    return path


def write_catalog(catalog: DataFrame, path: str) -> str:
    """Catalog as it comes, for readers of all of it (``read_snapshot``)."""
    catalog.select("query", "all_time_count", "recent_score", "last_ms").write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def prefix_filter(catalog: DataFrame, prefix: str) -> DataFrame:
    """Left-anchored prefix scan (``StringStartsWith`` is pushed to Parquet)."""
    return catalog.where(F.col("query").startswith(prefix))


def read_candidates_jdbc(spark: SparkSession, url: str, max_queries: int,
                         table: str = "queries", **props) -> DataFrame:
    """Optional candidate scan from a relational store (needs its JDBC driver
    on the classpath): the ORDER BY/LIMIT runs in the store, rows stream in
    with a 10,000-row fetch size."""
    q = (f"(SELECT query, all_time_count, recent_score FROM {table} "
         f"ORDER BY all_time_count DESC, query LIMIT {int(max_queries)}) c")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", q) \
        .option("fetchsize", 10_000)
    for k, v in props.items():
        r = r.option(k, v)
    return r.load()
