"""Contract queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Inputs are the views of ``sources.tables`` over the given parquet tables.
Doubles are rounded to ``SCORE_DIGITS`` so that an independent engine can
reproduce them; every computed column carries an explicit alias.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (AS_OF, CACHE_NODES, REQUEST_GAP_MS, SCORE_DIGITS, TOP_N,
                      VNODES, IndexParams)
from ..functions.hashing import hash60, unit_draw
from ..functions.scoring import to_epoch_ms
from ..operators import events as ev_ops
from ..operators import export as ex_ops
from ..operators import fold as fold_ops
from ..operators import lookup as lk
from ..operators import metrics as mt
from ..operators import prefix_index as px
from ..operators import recency as rc
from ..operators import ring as rg
from ..operators import rollup as ru
from ..operators import sketches as sk
from ..operators import weights as wt
from ..session import scratch_path
from . import incremental as inc
from . import publish as pub
from ..sources import catalog_io, events_io, range_store, tables
from ..streaming import debounce as dbn
from ..streaming import ingest as ing
from ..streaming import trending as trd

D = SCORE_DIGITS
GENERATION = 1
SAMPLE_EVERY = 4
CUT_N = 20_000


def _r(c: str):
    return F.round(F.col(c), D).alias(c)


# ---- building blocks ---------------------------------------------------------

def _folded(spark, sf):
    return fold_ops.fold_query_log(tables.term_log(spark, sf))


def _base_catalog(spark, sf):
    """Every folded query; cuts belong to the queries that are about cuts."""
    return fold_ops.to_catalog(_folded(spark, sf))


def _event_state(spark, sf):
    return rc.decayed_state(tables.search_events(spark, sf))


def _blended_catalog(spark, sf):
    return rc.upsert(_base_catalog(spark, sf), _event_state(spark, sf))


def _blended_cands(spark, sf):
    return px.candidates(_blended_catalog(spark, sf), IndexParams())


def _blended_index(spark, sf):
    return px.build_index(_blended_cands(spark, sf))


def _rounded(index):
    """Scores rounded after the ranking, so that another engine can agree."""
    return index.withColumn("score", F.round("score", D))


def _published(spark, sf, name, catalog):
    """Root of an index with one published generation, made once per session, as the
    rebuild job leaves it to its readers."""
    return tables.once(spark, sf, name, lambda root: pub.publish(spark, root, catalog(spark, sf), to_epoch_ms(AS_OF)))


def _blended_root(spark, sf):
    return _published(spark, sf, "blended-root", _blended_catalog)


def _blended_lists(spark, sf):
    """The published lists of the blended catalog, one row per prefix."""
    return pub.read_lists(spark, _blended_root(spark, sf), GENERATION).withColumn("suggestions", F.transform(
        "suggestions", lambda x: F.struct(x["query"].alias("query"), F.round(x["score"], D).alias("score"))))


def prepare(spark: SparkSession, sf: str) -> None:
    """Make the derived inputs that queries read (raw log, published generations)."""
    tables.term_log(spark, sf)
    _blended_root(spark, sf)
    _published(spark, sf, "base-root", _base_catalog)


def _ring(spark, nodes=CACHE_NODES):
    return rg.ring_points(spark, nodes, VNODES)


def _ring_keys(spark, sf):
    """Index nodes (every distinct prefix of a catalog query) are the keys the
    cache routes."""
    cat = _base_catalog(spark, sf)
    scored = cat.withColumn("score", F.lit(0.0))
    return px.explode_prefixes(scored).select("prefix").distinct()


# ---- catalog -----------------------------------------------------------------

def fold_query_log(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf)


def catalog_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return fold_ops.catalog_top_n(_folded(spark, sf), TOP_N)


def catalog_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The top-N cut with an N that bites, through the ties of its threshold."""
    return fold_ops.catalog_top_n(_folded(spark, sf), CUT_N)


def index_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The index of a candidate cut that bites."""
    return _rounded(px.build_index(px.candidates(_blended_catalog(spark, sf), IndexParams(max_queries=CUT_N))))


def index_decayed(spark: SparkSession, sf: str) -> DataFrame:
    """The index with recency decayed to the build's instant."""
    params = IndexParams(decay_to_ms=to_epoch_ms(AS_OF))
    return _rounded(px.build_index(px.candidates(_blended_catalog(spark, sf), params)))


def query_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-file scan of the stored raw log: rows and distinct terms."""
    log = pub.read_query_log(spark, tables.term_log_path(spark, sf) + "/*.parquet")
    per_term = log.groupBy("final_search_term").agg(F.count(F.lit(1)).alias("n"), F.max("popularity").alias("p"))
    return per_term.agg(F.sum("n").alias("log_rows"), F.count(F.lit(1)).alias("terms"),
                        F.max("p").alias("top_popularity"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, with tabs, quotes, commas, backslashes and line breaks around
    them, through the CSV hand-off.  A row counts if what came back is the whole
    text of its document (by hash); its first 200 characters are shown."""
    def odd(doc_id):
        k = F.col(doc_id) % 5
        return (F.when(k == 0, F.lit("\t")).when(k == 1, F.lit('"')).when(k == 2, F.lit(" \\")).when(k == 3, F.lit("\n,"))
                .otherwise(F.lit("")))

    docs = tables.read_table(spark, sf, "documents")
    rows = docs.select(F.concat(odd("doc_id"), "text", odd("doc_id")).alias("q"), F.col("doc_id").alias("cnt"))
    back = catalog_io.read_folded_csv(spark, catalog_io.write_folded_csv(rows, scratch_path(spark, "csv")))
    sent = rows.select(F.col("cnt").alias("sent_cnt"), F.xxhash64("q").alias("sent_hash")).distinct()
    whole = back.join(sent, F.col("cnt").eqNullSafe(F.col("sent_cnt")) & (F.xxhash64("q") == F.col("sent_hash")), "left_semi")
    around = F.length(odd("cnt"))
    text = F.substring("q", around + 1, F.length("q") - 2 * around)
    return whole.select(F.concat(odd("cnt"), F.substring(text, 1, 200), odd("cnt")).alias("q"), "cnt")


def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows, then the folded CSV written and read back: count/min/max."""
    log = tables.term_log(spark, sf)
    src = log.agg(F.count(F.lit(1)).alias("source_rows"))
    path = catalog_io.write_folded_csv(fold_ops.catalog_top_n(fold_ops.fold_query_log(log)),
                                       scratch_path(spark, "folded-csv"))
    back = catalog_io.read_folded_csv(spark, path)
    s = fold_ops.catalog_summary(back)
    nul = F.lit(None).cast("bigint")
    a = src.select("source_rows", nul.alias("n_rows"), nul.alias("min_cnt"), nul.alias("max_cnt"))
    b = s.select(nul.alias("source_rows"), "n_rows", "min_cnt", "max_cnt")
    return a.unionByName(b).agg(*[F.max(c).alias(c) for c in
                                  ("source_rows", "n_rows", "min_cnt", "max_cnt")])


def catalog_top5(spark: SparkSession, sf: str) -> DataFrame:
    return (_base_catalog(spark, sf).orderBy(F.desc("all_time_count"), F.asc("query"))
            .limit(5).select("query", "all_time_count"))


def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Full-refresh snapshot written range-sorted on query, then a pushed-down
    prefix scan of it."""
    path = catalog_io.write_snapshot(_base_catalog(spark, sf), scratch_path(spark, "snapshot"))
    snap = catalog_io.read_snapshot(spark, path)
    return catalog_io.prefix_filter(snap, "an").select("query", "all_time_count")


# ---- index -------------------------------------------------------------------

def prefix_index(spark: SparkSession, sf: str) -> DataFrame:
    cands = px.candidates(_base_catalog(spark, sf), IndexParams())
    return _rounded(px.build_index(cands))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    cands = px.candidates(_base_catalog(spark, sf), IndexParams())
    return px.index_stats(cands, px.build_index(cands))


def index_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The index merged bottom-up: K rows per longer prefix instead of every query."""
    return _rounded(ru.rollup_index(px.candidates(_base_catalog(spark, sf), IndexParams())))


def _taken_down(query="query"):
    """Queries that are to disappear from the index (by hash)."""
    return F.pmod(hash60(query), F.lit(97)) == 0


def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """An index of which a later state of the catalog changes some candidates: events
    raise and lower scores, some queries are taken down, others move up into the cut.
    Only touched lists are ranked again."""
    events, params = tables.search_events(spark, sf), IndexParams(max_queries=CUT_N)
    middle = to_epoch_ms(AS_OF) - 15 * 86_400_000
    before = rc.upsert(_base_catalog(spark, sf), rc.decayed_state(events.where(F.col("ts_ms") < middle)))
    path = catalog_io.write_catalog(before, scratch_path(spark, "catalog-before"))      # the log is folded once
    before, root = catalog_io.read_snapshot(spark, path), scratch_path(spark, "index-ranges")
    inc.create_index(spark, root, px.candidates(before, params), params)
    after = rc.upsert(before, rc.decayed_state(events.where(F.col("ts_ms") >= middle))).where(~_taken_down())
    inc.update_index(spark, root, inc.candidate_changes(spark, root, px.candidates(after, params)), params)
    flat = inc.read_lists(spark, root).select("prefix", F.posexplode("suggestions").alias("_k", "s"))
    return flat.select("prefix", (F.col("_k") + 1).alias("rank"), "s.query", F.round("s.score", D).alias("score"))


def lookup_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """One prefix of a published generation: one bucket is read."""
    return _rounded(pub.lookup_published(spark, _published(spark, sf, "base-root", _base_catalog), "th"))


def prefix_scan_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """All catalog queries under each request's prefix, from a catalog in key ranges:
    how many, how often searched, and the first of the most popular ones."""
    def write(root):
        range_store.create(spark, root, _base_catalog(spark, sf), "query")

    root = tables.once(spark, sf, "catalog-ranges", write)
    requests = tables.typed_prefixes(spark, sf)
    found = range_store.scan_prefixes(spark, root, "query", catalog_io.CATALOG_SCHEMA, requests.select("prefix").distinct())
    each = found.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("all_time_count").alias("searches"),
        F.min(F.struct((-F.col("all_time_count")).alias("c"), F.col("query").alias("query")))["query"].alias("best"))
    return (requests.join(each, "prefix", "left")
            .select("request_id", "prefix", F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"),
                    F.coalesce("searches", F.lit(0)).cast("long").alias("searches"), "best"))


def trending(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lk.trending(_blended_cands(spark, sf)))


def trending_display(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lk.trending_display(lk.trending(_blended_cands(spark, sf))))


def trending_recent(spark: SparkSession, sf: str) -> DataFrame:
    return lk.trending_recent(_blended_catalog(spark, sf)).select("query", _r("recent_score"))


# ---- recency -----------------------------------------------------------------

def recency_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    s = _event_state(spark, sf)
    return s.select("query", "all_time_count", _r("recent_score"), "last_ms")


def recency_flush_parity(spark: SparkSession, sf: str) -> DataFrame:
    s = rc.flush_parity_state(tables.search_events(spark, sf))
    return s.select("query", "all_time_count", _r("recent_score"), "last_ms")


def recency_as_of(spark: SparkSession, sf: str) -> DataFrame:
    s = rc.decay_to(_event_state(spark, sf), to_epoch_ms(AS_OF))
    return s.select("query", "all_time_count", _r("recent_score"), "last_ms")


def upsert_deltas(spark: SparkSession, sf: str) -> DataFrame:
    c = _blended_catalog(spark, sf)
    return c.select("query", "all_time_count", _r("recent_score"), "last_ms")


def upsert_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Two upserts of searches whose words the catalog holds: counts add, and the
    second one meets scores that the first one left."""
    talk = tables.talk_events(spark, sf)
    middle = to_epoch_ms(AS_OF) - 150_000_000
    first = rc.decayed_state(talk.where(F.col("ts_ms") < middle))
    second = rc.decayed_state(talk.where(F.col("ts_ms") >= middle))
    c = rc.upsert(rc.upsert(_base_catalog(spark, sf), first), second)
    return c.select("query", "all_time_count", _r("recent_score"), "last_ms")


def recency_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and recency seeded from a raw log that carries search times."""
    log = tables.search_events(spark, sf).select(F.col("query").alias("final_search_term"), F.col("ts").alias("search_time"))
    s = rc.seed_from_log(log)
    return s.select("query", "all_time_count", _r("recent_score"), "last_ms")


def blended_index(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_blended_index(spark, sf))


# ---- lookup ------------------------------------------------------------------

def suggest_bulk(spark: SparkSession, sf: str) -> DataFrame:
    return lk.suggest_bulk(tables.requests(spark, sf), _blended_lists(spark, sf))


def suggest_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk completion from the bucketed lists; scores are rounded after the join, so
    that the join is on the table as stored."""
    answers = lk.suggest_bulk(tables.requests(spark, sf), pub.read_lists(spark, _blended_root(spark, sf)))
    return answers.withColumn("score", F.round("score", D))


# ---- events ------------------------------------------------------------------

def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ev_ops.parse_events(tables.event_json(spark, sf))
    return ev_ops.fold_batch(parsed)


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return ev_ops.dead_letters(ev_ops.parse_events(tables.event_json(spark, sf)))


def write_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return mt.write_reduction(tables.search_events(spark, sf))


def sampled_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Count a 1-in-k hash sample of events and scale back up."""
    se = tables.search_events(spark, sf)
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return (se.where(F.pmod(h, F.lit(SAMPLE_EVERY)) == 0)
            .groupBy("query").agg((F.count(F.lit(1)) * SAMPLE_EVERY).alias("est_count")))


def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts from an at-least-once feed: the whole feed delivered twice,
    deduplicated on event id."""
    se = tables.search_events(spark, sf)
    feed = se.unionByName(se)
    return (feed.dropDuplicates(["event_id"])
            .groupBy("query").agg(F.count(F.lit(1)).alias("events")))


# ---- weights -----------------------------------------------------------------

def prefix_weights(spark: SparkSession, sf: str) -> DataFrame:
    return wt.prefix_weights(_base_catalog(spark, sf))


def prefix_cdf(spark: SparkSession, sf: str) -> DataFrame:
    c = wt.prefix_cdf(wt.prefix_weights(_base_catalog(spark, sf)))
    return c.select("p", "w", _r("lo"), _r("cdf"))


def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    cdf = wt.prefix_cdf(wt.prefix_weights(_base_catalog(spark, sf)))
    draws = tables.read_table(spark, sf, "events").select(
        "event_id", unit_draw("event_id").alias("u"))
    return wt.weighted_sample(draws, cdf).select("event_id", "p")


def prefix_weights_json(spark: SparkSession, sf: str) -> DataFrame:
    return wt.weights_json(wt.prefix_weights(_base_catalog(spark, sf)))


# ---- sharding ----------------------------------------------------------------

def ring_assign(spark: SparkSession, sf: str) -> DataFrame:
    return rg.assign(_ring_keys(spark, sf), "prefix", _ring(spark))


def ring_share(spark: SparkSession, sf: str) -> DataFrame:
    return rg.share(rg.assign(_ring_keys(spark, sf), "prefix", _ring(spark)))


def ring_remap(spark: SparkSession, sf: str) -> DataFrame:
    return rg.remap(_ring_keys(spark, sf), "prefix", _ring(spark),
                    _ring(spark, [n for n in CACHE_NODES if n != 2]))


def serving_export(spark: SparkSession, sf: str) -> DataFrame:
    return ex_ops.serving_export(_blended_lists(spark, sf), GENERATION, _ring(spark))


def export_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The export decoded again; every 13th entry (by its key's hash) is
    truncated on purpose and reads as an empty list."""
    exp = ex_ops.serving_export(_blended_lists(spark, sf), GENERATION, _ring(spark))
    torn = F.pmod(hash60("key"), F.lit(13)) == 0
    exp = exp.withColumn("value", F.when(torn, F.lit("[{")).otherwise(F.col("value")))
    return ex_ops.read_export(exp).select("key", F.size("suggestions").alias("n_suggestions"),
                                          F.get("suggestions", F.lit(0))["query"].alias("first_query"))


def routing_report(spark: SparkSession, sf: str) -> DataFrame:
    return ex_ops.routing_report(tables.requests(spark, sf), _blended_lists(spark, sf), GENERATION, _ring(spark))


# ---- metrics -----------------------------------------------------------------

def latency_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return mt.latency_by_outcome(tables.request_log(spark, sf))


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return mt.hit_rate(tables.request_log(spark, sf))


def slo_gate(spark: SparkSession, sf: str) -> DataFrame:
    return mt.slo_gate(tables.request_log(spark, sf))


def latency_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per outcome from stored daily sketches, each within the allowed
    error of its rank."""
    log = tables.request_log(spark, sf)
    path = scratch_path(spark, "latency-sketches")
    sk.latency_sketches(log).write.parquet(path)
    return sk.rank_errors(log, sk.span_percentiles(spark.read.parquet(path)))


def top_terms_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent queries of the raw log by sketch, counted exactly."""
    return sk.top_terms(tables.term_log(spark, sf), 20)


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return mt.latency_histogram(tables.request_log(spark, sf))


def debounce(spark: SparkSession, sf: str) -> DataFrame:
    return mt.debounce(tables.keystrokes(spark, sf), REQUEST_GAP_MS)


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Same answer as ``debounce``, as session windows (the streaming form)."""
    return dbn.settled_values(tables.keystrokes(spark, sf), REQUEST_GAP_MS)


def warm_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Export entries of the hottest prefixes, to pre-fill a new generation."""
    w = wt.prefix_weights(_base_catalog(spark, sf)).select(F.col("p").alias("prefix"), "w")
    exp = ex_ops.serving_export(_blended_lists(spark, sf), GENERATION, _ring(spark))
    return exp.join(F.broadcast(w), "prefix").select("shard", "prefix", "key", "ttl_s", "w")


def index_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Publish the blended catalog as generation 1 of a fresh index root and
    return its pointer record (candidates, nodes, rows, staleness)."""
    root = scratch_path(spark, "index-root")
    pub.publish(spark, root, _blended_catalog(spark, sf), to_epoch_ms(AS_OF))
    return pub.pointers(spark, root)


# ---- streaming ---------------------------------------------------------------

def _publish_feed(spark, sf):
    """The search events published as a keyed JSON feed (one folder per day)
    plus malformed lines; returns the feed folder."""
    feed = scratch_path(spark, "feed")
    events_io.write_event_files(tables.search_events(spark, sf), feed)
    events_io.write_raw_lines(tables.bad_event_lines(spark, sf), feed)
    return feed


def _ingest(spark, feed, root, **options):
    ing.start_ingest(events_io.read_event_stream(spark, feed, max_files_per_trigger=16),
                     root, root + "/_checkpoint", available_now=True, **options).awaitTermination()


def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Replay the feed through the streaming ingest (bounded micro-batches,
    availableNow) and read the merged state back."""
    feed = _publish_feed(spark, sf)
    root = scratch_path(spark, "ingest")
    _ingest(spark, feed, root)
    cat = ing.current_catalog(spark, root)
    return cat.select("query", "all_time_count", _r("recent_score"), "last_ms")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The feed delivered twice, deduplicated by event id in the stream."""
    feed = _publish_feed(spark, sf)
    events_io.write_event_files(tables.search_events(spark, sf), feed, mode="append")
    root = scratch_path(spark, "ingest-dedup")
    _ingest(spark, feed, root, dedup_within="3650 days")
    cat = ing.current_catalog(spark, root)
    return cat.select("query", "all_time_count", _r("recent_score"), "last_ms")


def compacted_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest, compact, ingest more, compact again, read: each event once."""
    se = tables.search_events(spark, sf)
    middle = to_epoch_ms(AS_OF) - 15 * 86_400_000
    feed, root = scratch_path(spark, "feed"), scratch_path(spark, "ingest-compact")
    bases = [scratch_path(spark, "compacted") for _ in range(2)]
    events_io.write_event_files(se.where(F.col("ts_ms") < middle), feed)
    _ingest(spark, feed, root)
    ing.compact(spark, root, None, bases[0])
    events_io.write_event_files(se.where(F.col("ts_ms") >= middle), feed, mode="append")
    _ingest(spark, feed, root)
    absorbed = ing.compact(spark, root, bases[0], bases[1])
    ing.vacuum(spark, root, absorbed)
    base, absorbed = ing.read_base(spark, bases[1])
    cat = ing.current_catalog(spark, root, base, absorbed)
    return cat.select("query", "all_time_count", _r("recent_score"), "last_ms")


def compacted_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog in key ranges; two ingests of searches, each folded into the ranges
    that it touches."""
    talk = tables.talk_events(spark, sf)
    middle = to_epoch_ms(AS_OF) - 150_000_000
    feed, root, base = scratch_path(spark, "feed"), scratch_path(spark, "ingest-ranges"), scratch_path(spark, "base-ranges")
    ing.create_base(spark, base, _base_catalog(spark, sf))
    for part, mode in ((talk.where(F.col("ts_ms") < middle), "overwrite"), (talk.where(F.col("ts_ms") >= middle), "append")):
        events_io.write_event_files(part, feed, mode=mode)
        _ingest(spark, feed, root)
        ing.vacuum(spark, root, ing.compact_ranges(spark, root, base))
    catalog, absorbed = ing.read_ranges(spark, base)
    return ing.current_catalog(spark, root, catalog, absorbed).select("query", "all_time_count", _r("recent_score"), "last_ms")


def ingest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the ingest observed of itself, still whole after its batches are compacted
    and removed."""
    feed, root, base = _publish_feed(spark, sf), scratch_path(spark, "ingest-metrics"), scratch_path(spark, "base-ranges")
    _ingest(spark, feed, root)
    ing.vacuum(spark, root, ing.compact_ranges(spark, root, base))
    m = ing.ingest_metrics(spark, root)
    return m.agg(F.sum("events").alias("events"), F.sum("dead_letters").alias("dead_letters"),
                 F.min("oldest_ms").alias("oldest_ms"), F.max("newest_ms").alias("newest_ms"))


def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """An ingest that stops after it wrote a batch but before that was noted in its
    checkpoint, and starts again on more input: the batch is replayed, nothing counts
    twice."""
    se = tables.search_events(spark, sf)
    middle = to_epoch_ms(AS_OF) - 15 * 86_400_000
    feed, root = scratch_path(spark, "feed"), scratch_path(spark, "ingest-resume")
    events_io.write_event_files(se.where(F.col("ts_ms") < middle), feed)
    _ingest(spark, feed, root)
    ing.forget_last_batch(spark, root + "/_checkpoint")
    events_io.write_event_files(se.where(F.col("ts_ms") >= middle), feed, mode="append")
    _ingest(spark, feed, root)
    again = ing.attempts(spark, root).where("attempts > 1").agg(F.count(F.lit(1)).alias("replayed"))
    cat = ing.current_catalog(spark, root).select("query", "all_time_count", _r("recent_score"), "last_ms")
    return cat.withColumn("replayed", again.scalar())


def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Debounce as a stream in three deliveries; every 50th value comes one delivery
    late, and is settled with the others or counted as late."""
    keys, gap, delay = tables.keystrokes(spark, sf), REQUEST_GAP_MS, 2 * REQUEST_GAP_MS
    days = 86_400_000
    part = F.when(F.col("ts_ms") < to_epoch_ms(AS_OF) - 20 * days, 0).when(F.col("ts_ms") < to_epoch_ms(AS_OF) - 10 * days, 1).otherwise(2)
    part = part + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)
    feed, out = scratch_path(spark, "keys"), scratch_path(spark, "debounce")

    def settle():
        dbn.start_settling(spark, out, out + "/_settling", gap, delay, available_now=True).awaitTermination()

    for k in range(4):
        events_io.write_feed_files(keys.withColumn("_part", part).where(F.col("_part") == k).drop("_part"), feed)
        raw = events_io.read_feed_stream(spark, feed, dbn.KEY_SCHEMA)
        dbn.start_admission(raw, out, out + "/_admission", delay, available_now=True).awaitTermination()
        if k == 1:
            settle()
    dbn.close_sessions(spark, out, gap, delay)
    settle()
    return (dbn.read_settled(spark, out).withColumn("late", F.lit(False))
            .unionByName(dbn.read_late(spark, out).withColumn("late", F.lit(True))))


def stream_trending(spark: SparkSession, sf: str) -> DataFrame:
    feed = _publish_feed(spark, sf)
    out = scratch_path(spark, "trending")
    q = trd.start_trending(events_io.read_event_stream(spark, feed, max_files_per_trigger=16),
                           out, out + "/_checkpoint", available_now=True)
    q.awaitTermination()
    t = trd.read_trending(spark, out, to_epoch_ms(AS_OF))
    return t.select("query", _r("score"))


def stream_trending_state(spark: SparkSession, sf: str) -> DataFrame:
    """Trending from the query's state; no updates are written."""
    checkpoint = scratch_path(spark, "trending-state")
    trd.start_state(events_io.read_event_stream(spark, _publish_feed(spark, sf), max_files_per_trigger=64), checkpoint,
                    available_now=True).awaitTermination()
    return trd.read_state(spark, checkpoint, to_epoch_ms(AS_OF)).select("query", _r("score"))


QUERIES = {
    "fold_query_log": fold_query_log,
    "catalog_top_n": catalog_top_n,
    "catalog_cut": catalog_cut,
    "index_cut": index_cut,
    "index_decayed": index_decayed,
    "query_log_scan": query_log_scan,
    "csv_round_trip": csv_round_trip,
    "catalog_summary": catalog_summary,
    "catalog_top5": catalog_top5,
    "prefix_filter": prefix_filter,
    "prefix_index": prefix_index,
    "index_stats": index_stats,
    "lookup_prefix": lookup_prefix,
    "trending": trending,
    "trending_display": trending_display,
    "trending_recent": trending_recent,
    "recency_closed_form": recency_closed_form,
    "recency_flush_parity": recency_flush_parity,
    "recency_as_of": recency_as_of,
    "upsert_deltas": upsert_deltas,
    "upsert_overlap": upsert_overlap,
    "recency_seeded": recency_seeded,
    "blended_index": blended_index,
    "suggest_bulk": suggest_bulk,
    "event_fold": event_fold,
    "dead_letters": dead_letters,
    "write_reduction": write_reduction,
    "sampled_counts": sampled_counts,
    "dedup_counts": dedup_counts,
    "prefix_weights": prefix_weights,
    "prefix_cdf": prefix_cdf,
    "weighted_sample": weighted_sample,
    "prefix_weights_json": prefix_weights_json,
    "ring_assign": ring_assign,
    "ring_share": ring_share,
    "ring_remap": ring_remap,
    "serving_export": serving_export,
    "routing_report": routing_report,
    "export_read_back": export_read_back,
    "latency_by_outcome": latency_by_outcome,
    "hit_rate": hit_rate,
    "slo_gate": slo_gate,
    "latency_histogram": latency_histogram,
    "debounce": debounce,
    "debounce_sessions": debounce_sessions,
    "warm_prefixes": warm_prefixes,
    "index_publish": index_publish,
    "stream_fold": stream_fold,
    "stream_dedup": stream_dedup,
    "compacted_catalog": compacted_catalog,
    "stream_trending": stream_trending,
    "compacted_partitions": compacted_partitions,
    "index_incremental": index_incremental,
    "suggest_bucketed": suggest_bucketed,
    "index_rollup": index_rollup,
    "prefix_scan_bulk": prefix_scan_bulk,
    "stream_debounce": stream_debounce,
    "stream_trending_state": stream_trending_state,
    "ingest_metrics": ingest_metrics,
    "latency_sketch": latency_sketch,
    "top_terms_sketch": top_terms_sketch,
    "stream_resume": stream_resume,
}
