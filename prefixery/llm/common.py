"""Shared Spark-side helpers of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixery.session import scratch_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands texts to Python in Arrow batches of
    at most ``BATCH_ROWS`` rows: Spark's 10,000 rows of long texts are a lot of
    memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The folders that ``stored`` writes meanwhile."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)


def remove_scratch(paths: list[str], docs: DataFrame) -> None:
    """Remove folders of ``scratch_scope`` (and empty the list), unless ``docs`` still
    reads one of them."""
    names = [p.rsplit("/", 1)[-1] for p in paths]
    if not names or any(n in f for f in docs.inputFiles() for n in names):
        return
    _delete(docs.sparkSession, paths)
    paths.clear()


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun meanwhile remove their shuffle files when they end; else these
    stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage,
    survives the loss of executors, and fixes partition contents."""
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` returned and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t.stored_at])


def by_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    return small_batches(df).mapInArrow(fn, schema)


def packed_suffix(g: Column, size: int) -> Column:
    """The last ``size`` bytes of a packed gram."""
    return g.bitwiseAND(F.lit((1 << (8 * size)) - 1))
