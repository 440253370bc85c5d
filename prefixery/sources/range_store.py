"""A keyed table in key ranges, of which a change rewrites only the touched ones.

Each range (slot) is a folder of files sorted on the key.  A generation is a manifest:
one row per slot with its lowest key, folder and row count, written last.  A new
generation names the folders of untouched slots again and has new folders for the
others; a slot that has grown beyond ``split_rows`` is split.  Readers take the newest
manifest, so a rewrite that dies half-way is never seen.

What reaches the driver is the manifest (a row per slot).  A key is routed to its slot
by two levels of comparison with the slots' lowest keys, an expression without a
join.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

MANIFEST = "slot int, low string, path string, n_rows bigint"
GROUP = 64                 # lowest keys per group of the router
SPLIT_ROWS = 2_000_000


def generation(spark: SparkSession, root: str) -> int:
    """The newest generation, 0 before the first."""
    try:
        rows = spark.read.schema(MANIFEST + ", gen int").json(f"{root}/manifest")
        return int(rows.agg(F.max("gen")).first()[0] or 0)
    except AnalysisException:
        return 0


def manifest(spark: SparkSession, root: str, gen: int | None = None) -> list:
    """The slots of a generation in key order: rows (slot, low, path, n_rows)."""
    g = gen or generation(spark, root)
    if not g:
        return []
    return spark.read.schema(MANIFEST).json(f"{root}/manifest/gen={g}").orderBy("slot").collect()


def _commit(spark: SparkSession, root: str, gen: int, slots: list[tuple]) -> None:
    rows = [(k, low if k else "", path, n) for k, (low, path, n) in enumerate(sorted(slots))]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/gen={gen}")


def _folded(bounds: list[str], holds: Callable[[Column], Column]) -> Column:
    """How many of the sorted bounds hold; ``holds`` is true up to one of them."""
    groups = [bounds[k:k + GROUP] for k in range(0, len(bounds), GROUP)]
    tops = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<string>")
    whole = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")
    top = F.size(F.filter(tops, holds))
    own = F.size(F.filter(F.get(whole, top - 1), holds))
    return F.when(top > 0, (top - 1) * GROUP + own).otherwise(0)


def router(slots: list) -> Callable[[Column], Column]:
    """Slot number of a key."""
    bounds = [r["low"] for r in slots]
    return lambda key: (_folded(bounds, lambda b: b <= key) - 1).cast("int")


def last_slot(slots: list) -> Callable[[Column], Column]:
    """Last slot that can hold keys with a given prefix."""
    bounds = [r["low"] for r in slots]
    return lambda prefix: (_folded(bounds, lambda b: (b <= prefix) | b.startswith(prefix)) - 1).cast("int")


def create(spark: SparkSession, root: str, rows: DataFrame, key: str, slots: int | None = None) -> int:
    """Write ``rows`` (one per key) as a new generation of fresh slots."""
    gen = generation(spark, root) + 1
    n = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(n, key).withColumn("slot", F.spark_partition_id()).sortWithinPartitions("slot", key)
     .write.mode("errorifexists").partitionBy("slot").parquet(f"{root}/data/gen={gen}"))
    _commit(spark, root, gen, _sizes(spark, root, gen, key, rows, []))
    return gen


def _sizes(spark, root, gen, key, like: DataFrame, pieces: list[str]) -> list[tuple]:
    """(low, path, rows) of the folders that this generation wrote."""
    by = ["slot", *pieces]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    written = spark.read.schema(f"{schema}, " + ", ".join(f"{c} int" for c in by)).parquet(f"{root}/data/gen={gen}")
    rows = written.groupBy(*by).agg(F.min(key).alias("low"), F.count("*").alias("n")).collect()      # a row per folder
    return [(r["low"], f"data/gen={gen}/" + "/".join(f"{c}={r[c]}" for c in by), r["n"]) for r in rows]


def read(spark: SparkSession, root: str, schema: str, gen: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a generation, or of some of its slots."""
    paths = [f"{root}/{r['path']}" for r in manifest(spark, root, gen) if only is None or r["slot"] in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rewrite(spark: SparkSession, root: str, key: str, schema: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
            split_rows: int = SPLIT_ROWS, before_commit: Callable[[int], None] | None = None) -> int:
    """Merge ``changes`` (any columns, with the key) into the slots that they touch:
    ``merge(rows of these slots, changes)`` gives their new rows.  Returns the new
    generation, or the current one if nothing was to change."""
    slots = manifest(spark, root)
    if not slots:
        fresh = merge(spark.createDataFrame([], schema), changes)
        if before_commit:
            before_commit(generation(spark, root) + 1)
        return create(spark, root, fresh, key)
    gen, route = generation(spark, root) + 1, router(slots)
    path = scratch_path(spark, "range-changes")
    changes.withColumn("slot", route(F.col(key))).write.parquet(path)
    routed = spark.read.parquet(path)
    touched = {r["slot"] for r in routed.select("slot").distinct().collect()}                       # at most one row per slot
    if not touched:
        return gen - 1
    new = merge(read(spark, root, schema, gen - 1, sorted(touched)), routed.drop("slot"))
    order = Window.partitionBy("slot").orderBy(key)
    (new.withColumn("slot", route(F.col(key)))
     .withColumn("piece", F.floor((F.row_number().over(order) - 1) / split_rows).cast("int"))
     .sortWithinPartitions("slot", "piece", key)
     .write.mode("errorifexists").partitionBy("slot", "piece").parquet(f"{root}/data/gen={gen}"))
    fresh = _sizes(spark, root, gen, key, new, ["piece"])
    first = {r["slot"]: r["low"] for r in slots}
    by_slot = {}
    for low, folder, n in fresh:
        by_slot.setdefault(int(folder.split("slot=")[1].split("/")[0]), []).append((low, folder, n))
    kept = [(r["low"], r["path"], r["n_rows"]) for r in slots if r["slot"] not in touched]
    for slot, own in by_slot.items():
        own.sort()
        kept += [(first[slot], *own[0][1:]), *own[1:]]
    if before_commit:
        before_commit(gen)
    _commit(spark, root, gen, kept)
    return gen


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the slot folders and manifests that the newest generation does not
    name; returns how many.  Only once every reader has moved to it."""
    now = generation(spark, root)
    named = {r["path"] for r in manifest(spark, root, now)}
    jvm, n = spark.sparkContext._jvm, 0
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def below(folder: str) -> list[str]:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def drop(folder: str) -> int:
        return int(fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}"), True))

    n += sum(drop(f"manifest/{g}") for g in below("manifest") if int(g.partition("=")[2]) < now)
    for g in below("data"):
        if int(g.partition("=")[2]) > now:
            continue
        for slot in below(f"data/{g}"):
            own = [f"data/{g}/{slot}/{p}" for p in below(f"data/{g}/{slot}")] or [f"data/{g}/{slot}"]
            n += sum(drop(folder) for folder in own if folder not in named)
    return n


def scan_prefixes(spark: SparkSession, root: str, key: str, schema: str, prefixes: DataFrame, gen: int | None = None) -> DataFrame:
    """(prefix, row...) for every row whose key starts with one of the ``prefix``
    values (distinct, not null), of any length.

    A prefix is the interval [p, next(p)) of keys.  It is dealt to the slots that the
    interval meets, and only these are read.  Within a slot a row meets prefixes by its
    own first characters, one equality per length that the slot's prefixes have, so
    there is no nested loop.  The dealt prefixes are stored: while they are few, Spark
    broadcasts them and no row is shuffled."""
    slots = manifest(spark, root, gen)
    if not slots:
        return spark.createDataFrame([], f"prefix string, {schema}")
    p = F.col("prefix")
    dealt = prefixes.select("prefix").withColumn("slot", F.explode(F.sequence(router(slots)(p), last_slot(slots)(p))))
    path = scratch_path(spark, "prefix-slots")
    dealt.write.parquet(path)
    dealt = spark.read.schema("prefix string, slot int").parquet(path)
    lengths = dealt.groupBy("slot").agg(F.collect_set(F.length("prefix")).alias("lengths"))          # a row per slot
    touched = sorted(r["slot"] for r in lengths.select("slot").collect())
    rows = read(spark, root, schema, gen, touched).withColumn("slot", router(slots)(F.col(key)))
    names = [f.name for f in rows.schema.fields if f.name != "slot"]
    heads = (rows.join(F.broadcast(lengths), "slot").select("slot", *names, F.explode("lengths").alias("_n"))
             .where(F.length(key) >= F.col("_n")).withColumn("prefix", F.expr(f"left(`{key}`, _n)")).drop("_n"))
    return heads.join(dealt, ["slot", "prefix"]).select("prefix", *names)
