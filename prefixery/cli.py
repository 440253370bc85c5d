"""Command line: the operational jobs over storage paths.

    python -m prefixery load     --log 'raw/*.parquet' --out base/ [--top-n N] [--csv out.csv]
    python -m prefixery ingest   --feed feed/ --state state/ [--once] [--kafka-servers h:p --topic t]
    python -m prefixery compact  --state state/ --base base/ --out base2/ [--vacuum]
    python -m prefixery fold     --state state/ --ranges base-ranges/ [--base base/] [--vacuum]
    python -m prefixery refresh  --root idx-ranges/ --ranges base-ranges/ [--state state/] --published-ms MS
    python -m prefixery metrics  --state state/
    python -m prefixery publish  --root idx/ --base base/ [--state state/] --published-ms MS
    python -m prefixery suggest  --root idx/ --requests req.parquet --out answers/
    python -m prefixery lookup   --root idx/ --prefix iph
    python -m prefixery scan     --ranges base-ranges/ --prefixes prefixes.parquet --out found/
    python -m prefixery export   --root idx/ --out cache/ [--nodes 0,1,2]
    python -m prefixery weights  --base base/ --out weights/

Every command is a Spark job; paths may be any Hadoop-compatible URI.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .config import CACHE_NODES, FLUSH_INTERVAL_MS, FLUSH_SIZE, TOP_N, VNODES, IndexParams
from .operators import export as ex_ops
from .operators import lookup as lk
from .operators import ring as rg
from .operators import weights as wt
from .plans import incremental as inc
from .plans import publish as pub
from .session import build_session
from .sources import catalog_io, events_io
from .sources import range_store as rs
from .streaming import ingest as ing


def _nodes(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def cmd_load(spark, a):
    log = pub.read_query_log(spark, a.log)
    row = pub.load_catalog(spark, log, a.out, a.top_n, a.csv).collect()[0]
    return row.asDict()


def cmd_ingest(spark, a):
    if a.kafka_servers:
        raw = events_io.read_event_stream(spark, "", fmt="kafka", flush_size=a.flush_size,
                                          flush_interval_ms=a.flush_ms,
                                          **{"kafka.bootstrap.servers": a.kafka_servers,
                                             "subscribe": a.topic})
    else:
        raw = events_io.read_event_stream(spark, a.feed, a.max_files)
    ck = a.checkpoint or f"{a.state}/_checkpoint"
    q = ing.start_ingest(raw, a.state, ck, a.stream_id, available_now=a.once,
                         interval_ms=a.flush_ms)
    q.awaitTermination()
    return {"stream": a.stream_id, "state": a.state}


def cmd_compact(spark, a):
    absorbed = ing.compact(spark, a.state, a.base, a.out)
    if a.vacuum:
        ing.vacuum(spark, a.state, absorbed)
    return {"absorbed": absorbed}


def cmd_fold(spark, a):
    """Fold new batches into a base in key ranges (made from ``--base`` the first time)."""
    if not rs.generation(spark, a.ranges):
        if not a.base:
            raise SystemExit("--base names the catalog that the ranges begin with")
        ing.create_base(spark, a.ranges, ing.read_base(spark, a.base)[0], a.slots)
    before = {r["path"] for r in rs.manifest(spark, a.ranges)}
    absorbed = ing.compact_ranges(spark, a.state, a.ranges)
    after = {r["path"] for r in rs.manifest(spark, a.ranges)}
    if a.vacuum:
        ing.vacuum(spark, a.state, absorbed)
        rs.vacuum(spark, a.ranges)
    return {"absorbed": absorbed, "slots": len(after), "rewritten": len(after - before)}


def cmd_refresh(spark, a):
    """The index in key ranges: whole the first time, then only what has changed."""
    catalog, absorbed = ing.read_ranges(spark, a.ranges)
    if a.state:
        catalog = ing.current_catalog(spark, a.state, catalog, absorbed)
    return inc.refresh(spark, a.root, catalog, a.published_ms, IndexParams(decay_to_ms=a.published_ms if a.decay else None), a.slots)


def cmd_metrics(spark, a):
    m = ing.ingest_metrics(spark, a.state)
    return m.agg(F.sum("events").alias("events"), F.sum("dead_letters").alias("dead_letters"), F.sum("rows").alias("rows"),
                 F.count(F.lit(1)).alias("batches"), F.max("newest_ms").alias("newest_ms")).first().asDict()


def cmd_lookup(spark, a):
    rows = pub.lookup_published(spark, a.root, a.prefix.strip().lower()).orderBy("rank").collect()    # at most K rows
    return {"prefix": a.prefix, "suggestions": [[r["query"], r["score"]] for r in rows]}


def cmd_scan(spark, a):
    """All catalog queries under each given prefix."""
    prefixes = spark.read.parquet(a.prefixes).select("prefix").where("prefix IS NOT NULL").distinct()
    rs.scan_prefixes(spark, a.ranges, "query", catalog_io.CATALOG_SCHEMA, prefixes).write.mode("overwrite").parquet(a.out)
    return {"out": a.out}


def cmd_publish(spark, a):
    cat, absorbed = ing.read_base(spark, a.base)
    if a.state:
        cat = ing.current_catalog(spark, a.state, cat, absorbed)
    gen = pub.publish(spark, a.root, cat, a.published_ms, IndexParams(decay_to_ms=a.published_ms if a.decay else None))
    ptr = pub.pointers(spark, a.root).where(F.col("generation") == gen).collect()[0]
    return ptr.asDict()


def cmd_suggest(spark, a):
    gen = pub.current_generation(spark, a.root)
    nested = pub.read_lists(spark, a.root, gen)
    req = spark.read.parquet(a.requests)
    lk.suggest_bulk(req, nested).write.mode("overwrite").parquet(a.out)
    return {"generation": gen, "out": a.out}


def cmd_export(spark, a):
    gen = pub.current_generation(spark, a.root)
    nested = pub.read_lists(spark, a.root, gen)
    points = rg.ring_points(spark, _nodes(a.nodes), a.vnodes)
    (ex_ops.serving_export(nested, gen, points)
     .write.mode("overwrite").option("partitionOverwriteMode", "static")    # no shard of a larger ring stays
     .partitionBy("shard").parquet(f"{a.out}/gen={gen}"))
    return {"generation": gen, "out": f"{a.out}/gen={gen}"}


def cmd_weights(spark, a):
    w = wt.prefix_weights(ing.read_base(spark, a.base)[0])
    wt.weights_json(w).write.mode("overwrite").text(a.out)
    return {"out": a.out}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prefixery")
    p.add_argument("--master", default=None)
    p.add_argument("--profile", default="local", choices=["local", "cluster"])
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("load")
    s.add_argument("--log", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--top-n", type=int, default=TOP_N)
    s.add_argument("--csv", default=None)

    s = sub.add_parser("ingest")
    s.add_argument("--feed", default="")
    s.add_argument("--state", required=True)
    s.add_argument("--checkpoint", default=None)
    s.add_argument("--stream-id", default="s0")
    s.add_argument("--once", action="store_true")
    s.add_argument("--max-files", type=int, default=16)
    s.add_argument("--flush-ms", type=int, default=FLUSH_INTERVAL_MS)
    s.add_argument("--flush-size", type=int, default=FLUSH_SIZE)
    s.add_argument("--kafka-servers", default=None)
    s.add_argument("--topic", default="search-events")

    s = sub.add_parser("compact")
    s.add_argument("--state", required=True)
    s.add_argument("--base", default=None)
    s.add_argument("--out", required=True)
    s.add_argument("--vacuum", action="store_true", help="remove the absorbed batches")

    s = sub.add_parser("fold")
    s.add_argument("--state", required=True)
    s.add_argument("--ranges", required=True)
    s.add_argument("--base", default=None)
    s.add_argument("--slots", type=int, default=None)
    s.add_argument("--vacuum", action="store_true", help="remove absorbed batches and replaced files")

    s = sub.add_parser("refresh")
    s.add_argument("--root", required=True)
    s.add_argument("--ranges", required=True)
    s.add_argument("--state", default=None)
    s.add_argument("--published-ms", type=int, required=True)
    s.add_argument("--decay", action="store_true", help="decay recency to the publish time (changes every searched query)")
    s.add_argument("--slots", type=int, default=None)

    s = sub.add_parser("metrics")
    s.add_argument("--state", required=True)

    s = sub.add_parser("lookup")
    s.add_argument("--root", required=True)
    s.add_argument("--prefix", required=True)

    s = sub.add_parser("scan")
    s.add_argument("--ranges", required=True)
    s.add_argument("--prefixes", required=True)
    s.add_argument("--out", required=True)

    s = sub.add_parser("publish")
    s.add_argument("--root", required=True)
    s.add_argument("--base", required=True)
    s.add_argument("--state", default=None)
    s.add_argument("--published-ms", type=int, required=True)
    s.add_argument("--decay", action="store_true", help="decay recency to the publish time")

    s = sub.add_parser("suggest")
    s.add_argument("--root", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--out", required=True)

    s = sub.add_parser("export")
    s.add_argument("--root", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--nodes", default=",".join(str(n) for n in CACHE_NODES))
    s.add_argument("--vnodes", type=int, default=VNODES)

    s = sub.add_parser("weights")
    s.add_argument("--base", required=True)
    s.add_argument("--out", required=True)
    return p


COMMANDS = {"load": cmd_load, "ingest": cmd_ingest, "compact": cmd_compact, "fold": cmd_fold,
            "refresh": cmd_refresh, "metrics": cmd_metrics, "lookup": cmd_lookup, "scan": cmd_scan,
            "publish": cmd_publish, "suggest": cmd_suggest, "export": cmd_export,
            "weights": cmd_weights}


def main(argv=None, spark=None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or build_session(a.master, profile=a.profile)
    out = COMMANDS[a.cmd](spark, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
