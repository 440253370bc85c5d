"""DuckDB SQL equivalents of the contract queries (same column names and types),
from the operators' definitions, over the same pre-registered parquet views.
"""

from __future__ import annotations

H_MS = "21600000.0"          # half-life in milliseconds
AS_OF_MS = "1706659200000"   # 2024-01-31 00:00:00 UTC

TERM_LOG = r"""
tok AS (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents)"""

FOLDED = TERM_LOG + r""",
folded AS (  -- a term's popularity is its number of tokens, so a query's count is that of its tokens
  SELECT keyed.q, count(*) AS cnt FROM (SELECT lower(trim(token)) AS q FROM tok) keyed
  WHERE keyed.q <> '' GROUP BY keyed.q)"""

BASE_CATALOG = FOLDED + r""",
catalog AS (SELECT q AS query, cnt AS all_time_count, 0.0::DOUBLE AS recent_score FROM folded)"""

SEARCH_EVENTS = r"""
se AS (
  SELECT e.event_id, lower(regexp_replace(p.p_name, '^\s+|\s+$', '', 'g')) AS query,
         (epoch_us(e.ts) // 1000) AS ts_ms
  FROM events e JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""

EVENT_STATE = SEARCH_EVENTS + f""",
se_t AS (SELECT *, max(ts_ms) OVER (PARTITION BY query) AS t_last FROM se),
state AS (
  SELECT query, CAST(count(*) AS BIGINT) AS all_time_count,
         sum(pow(0.5, (t_last - ts_ms) / {H_MS})) AS recent_score, t_last AS last_ms
  FROM se_t GROUP BY query, t_last)"""

BLENDED = BASE_CATALOG + "," + EVENT_STATE + r""",
blended AS (
  SELECT coalesce(c.query, s.query) AS query,
         CAST(coalesce(c.all_time_count, 0) + coalesce(s.all_time_count, 0) AS BIGINT) AS all_time_count,
         coalesce(s.recent_score, 0.0) AS recent_score, s.last_ms AS last_ms
  FROM catalog c FULL OUTER JOIN state s ON c.query = s.query)"""


def _index(catalog: str, name: str, cut: int = 300000) -> str:
    """Ranked on the whole score, rounded after that."""
    return f""",
{name}_cands AS (
  SELECT query, ln(1 + all_time_count) + recent_score AS score
  FROM {catalog} ORDER BY all_time_count DESC, query LIMIT {cut}),
{name}_exploded AS (
  SELECT left(query, CAST(i AS BIGINT)) AS prefix, query, score
  FROM (SELECT query, score, unnest(range(0, length(query) + 1)) AS i FROM {name}_cands)),
{name}_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query) AS INTEGER) AS rank
  FROM {name}_exploded),
{name} AS (SELECT prefix, rank, query, round(score, 6) AS score FROM {name}_ranked WHERE rank <= 10)"""


INDEX = BASE_CATALOG + _index("catalog", "idx")
BLENDED_INDEX = BLENDED + _index("blended", "bidx")
DECAYED = BLENDED + f""",
decayed AS (
  SELECT query, all_time_count,
         CASE WHEN last_ms IS NULL THEN recent_score
              ELSE recent_score * pow(0.5, greatest({AS_OF_MS} - last_ms, 0) / {H_MS}) END AS recent_score
  FROM blended)"""

REQUESTS = r""",
req AS (SELECT event_id AS request_id, left(query, CAST(event_id % 6 AS BIGINT))
                 || CASE WHEN event_id % 7 = 3 THEN '~zq' ELSE '' END AS raw_prefix FROM se),
nreq AS (
  SELECT request_id, raw_prefix,
         (raw_prefix IS NULL OR length(regexp_replace(raw_prefix, '^\s+|\s+$', '', 'g')) = 0) AS bypass,
         lower(regexp_replace(raw_prefix, '^\s+|\s+$', '', 'g')) AS norm
  FROM req)"""

RING = r"""
ring0 AS (
  SELECT n AS node, ('0x' || substr(md5(CAST(n AS VARCHAR) || '#' || CAST(v AS VARCHAR)), 1, 15))::BIGINT AS pos
  FROM range(3) a(n), range(150) b(v)),
ring AS (SELECT pos, max(node) AS node FROM ring0 GROUP BY pos),
ring_first AS (SELECT node FROM ring ORDER BY pos LIMIT 1),
ring2 AS (SELECT pos, max(node) AS node FROM ring0 WHERE node <> 2 GROUP BY pos),
ring2_first AS (SELECT node FROM ring2 ORDER BY pos LIMIT 1)"""

RING_KEYS = BASE_CATALOG + "," + RING + r""",
rkeys AS (SELECT DISTINCT left(query, CAST(i AS BIGINT)) AS prefix
          FROM (SELECT query, unnest(range(0, length(query) + 1)) AS i FROM catalog)),
kh AS (SELECT prefix, ('0x' || substr(md5(prefix), 1, 15))::BIGINT AS h FROM rkeys),
assigned AS (
  SELECT kh.prefix, CAST(coalesce(r.node, (SELECT node FROM ring_first)) AS INTEGER) AS node
  FROM kh ASOF LEFT JOIN ring r ON kh.h <= r.pos),
assigned2 AS (
  SELECT kh.prefix, CAST(coalesce(r.node, (SELECT node FROM ring2_first)) AS INTEGER) AS node
  FROM kh ASOF LEFT JOIN ring2 r ON kh.h <= r.pos)"""

TOP_PREFIXES = r""",
typed AS (SELECT * FROM catalog WHERE regexp_matches(query, '^[a-z0-9]')),
two AS (SELECT left(query, 2) AS p, sum(all_time_count)::BIGINT AS w FROM typed WHERE length(query) > 1 GROUP BY 1),
three AS (SELECT left(query, 3) AS p, sum(all_time_count)::BIGINT AS w FROM typed WHERE length(query) > 2 GROUP BY 1),
weights AS (SELECT * FROM (FROM two UNION ALL FROM three) ORDER BY w DESC, p LIMIT 300)"""

WEIGHTS = BASE_CATALOG + TOP_PREFIXES + r""",
cdf AS (
  SELECT p, w,
         (sum(w) OVER (ORDER BY w DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w)
           / sum(w) OVER () AS lo,
         sum(w) OVER (ORDER BY w DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / sum(w) OVER () AS cdf
  FROM weights)"""

EXPORT = BLENDED_INDEX + "," + RING + r""",
nested AS (
  SELECT prefix, to_json(list(struct_pack(query := query, score := score) ORDER BY rank)) AS value
  FROM bidx GROUP BY prefix),
export AS (
  SELECT n.prefix, 'suggest:v1:' || n.prefix AS key, n.value,
         CAST(60 + (('0x' || substr(md5('suggest:v1:' || n.prefix), 1, 15))::BIGINT % 16) AS INTEGER) AS ttl_s,
         ('0x' || substr(md5(n.prefix), 1, 15))::BIGINT AS h
  FROM nested n),
export_owned AS (
  SELECT e.*, coalesce(r.node, (SELECT node FROM ring_first)) AS node
  FROM export e ASOF LEFT JOIN ring r ON e.h <= r.pos)"""

REQUEST_LOG = r"""
rl AS (SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN 'MISS' ELSE 'HIT' END AS outcome,
              value AS latency_ms FROM events)  -- blank requests are not timed and stay out
"""

ORACLES = {
    "fold_query_log": "WITH " + FOLDED + " SELECT q, cnt FROM folded",
    "catalog_top_n": "WITH " + FOLDED + " SELECT q, cnt FROM folded ORDER BY cnt DESC, q LIMIT 1000000",
    "catalog_summary": "WITH " + BASE_CATALOG + """
        SELECT (SELECT count(*) FROM tok) AS source_rows, count(*) AS n_rows, min(cnt) AS min_cnt, max(cnt) AS max_cnt
        FROM (SELECT cnt FROM folded ORDER BY cnt DESC, q LIMIT 1000000)""",
    "catalog_cut": "WITH " + FOLDED + " SELECT q, cnt FROM folded ORDER BY cnt DESC, q LIMIT 20000",
    "index_cut": "WITH " + BLENDED + _index("blended", "cidx", 20000) + " SELECT prefix, rank, query, score FROM cidx",
    "index_decayed": "WITH " + DECAYED + _index("decayed", "didx") + " SELECT prefix, rank, query, score FROM didx",
    "query_log_scan": "WITH " + TERM_LOG + """
        SELECT CAST(sum(n) AS BIGINT) AS log_rows, count(*) AS terms, max(n) AS top_popularity
        FROM (SELECT token, count(*) AS n FROM tok GROUP BY token)""",
    "csv_round_trip": r"""
        SELECT odd || left(text, 200) || odd AS q, doc_id AS cnt FROM (
            SELECT text, doc_id, CASE doc_id % 5 WHEN 0 THEN chr(9) WHEN 1 THEN '"' WHEN 2 THEN ' \' WHEN 3 THEN chr(10) || ','
                                 ELSE '' END AS odd FROM documents)""",
    "catalog_top5": "WITH " + BASE_CATALOG + """
        SELECT query, all_time_count FROM catalog ORDER BY all_time_count DESC, query LIMIT 5""",
    "prefix_filter": "WITH " + BASE_CATALOG + """
        SELECT query, all_time_count FROM catalog WHERE starts_with(query, 'an')""",
    "prefix_index": "WITH " + INDEX + " SELECT prefix, rank, query, score FROM idx",
    "index_stats": "WITH " + INDEX + """
        SELECT (SELECT CAST(count(*) AS BIGINT) FROM idx_cands) AS candidates,
               CAST(count(DISTINCT prefix) AS BIGINT) AS nodes, CAST(count(*) AS BIGINT) AS index_rows
        FROM idx""",
    "lookup_prefix": "WITH " + INDEX + " SELECT prefix, rank, query, score FROM idx WHERE prefix = 'th'",
    "trending": "WITH " + BLENDED_INDEX + """
        SELECT query, round(score, 6) AS score FROM bidx_cands ORDER BY bidx_cands.score DESC, query LIMIT 10""",
    "trending_display": "WITH " + BLENDED_INDEX + """
        SELECT query, round(score, 6) AS score FROM bidx_cands ORDER BY bidx_cands.score DESC, query LIMIT 8""",
    "trending_recent": "WITH " + BLENDED + """
        SELECT query, round(recent_score, 6) AS recent_score FROM blended
        ORDER BY recent_score DESC, query LIMIT 10""",
    "recency_closed_form": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM state""",
    "recency_flush_parity": "WITH " + SEARCH_EVENTS + f""",
        fl AS (SELECT floor(ts_ms / 5000) AS flush_id, query, count(*) AS delta, max(ts_ms) AS qt
               FROM se GROUP BY 1, 2),
        fm AS (SELECT flush_id, max(qt) AS flush_ms FROM fl GROUP BY 1),
        d AS (SELECT fl.query, fl.delta, fm.flush_ms,
                     max(fm.flush_ms) OVER (PARTITION BY fl.query) AS t_last
              FROM fl JOIN fm USING (flush_id))
        SELECT query, CAST(sum(delta) AS BIGINT) AS all_time_count,
               round(sum(delta * pow(0.5, (t_last - flush_ms) / {H_MS})), 6) AS recent_score,
               t_last AS last_ms
        FROM d GROUP BY query, t_last""",
    "recency_as_of": "WITH " + EVENT_STATE + f"""
        SELECT query, all_time_count,
               round(recent_score * pow(0.5, greatest({AS_OF_MS} - last_ms, 0) / {H_MS}), 6) AS recent_score,
               last_ms FROM state""",
    "upsert_overlap": "WITH " + BASE_CATALOG + f""",
        talk AS (SELECT lower(trim(word)) AS query, {AS_OF_MS} - (conv_id % 500) * 600000 - turn * 1000 AS ts_ms
                 FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM conversations)
                 WHERE trim(word) <> ''),
        last AS (SELECT query, max(ts_ms) AS t, count(*) AS n FROM talk GROUP BY query),
        heat AS (SELECT query, sum(pow(0.5, (t - ts_ms) / {H_MS})) AS s FROM talk JOIN last USING (query) GROUP BY query)
        SELECT query, CAST(coalesce(c.all_time_count, 0) + coalesce(l.n, 0) AS BIGINT) AS all_time_count,
               round(coalesce(h.s, 0.0), 6) AS recent_score, CAST(l.t AS BIGINT) AS last_ms
        FROM catalog c FULL JOIN last l USING (query) LEFT JOIN heat h USING (query)""",
    "recency_seeded": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM state""",
    "upsert_deltas": "WITH " + BLENDED + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM blended""",
    "blended_index": "WITH " + BLENDED_INDEX + " SELECT prefix, rank, query, score FROM bidx",
    "suggest_bulk": "WITH " + BLENDED_INDEX + REQUESTS + """
        SELECT r.request_id, CASE WHEN r.bypass THEN NULL ELSE r.norm END AS prefix,
               CASE WHEN r.bypass THEN 'BYPASS' WHEN i.prefix IS NULL THEN 'EMPTY' ELSE 'FOUND' END AS status,
               i.rank AS rank, i.query AS query, i.score AS score,
               CASE WHEN starts_with(lower(i.query), lower(r.norm)) THEN left(i.query, length(r.norm)) END AS match_head,
               CASE WHEN starts_with(lower(i.query), lower(r.norm)) THEN substr(i.query, length(r.norm) + 1) END AS match_tail
        FROM nreq r LEFT JOIN bidx i ON NOT r.bypass AND i.prefix = r.norm""",
    "event_fold": "WITH " + SEARCH_EVENTS + """
        SELECT query, CAST(count(*) AS BIGINT) AS delta, max(ts_ms) AS max_ts_ms FROM se GROUP BY query""",
    "dead_letters": "WITH " + SEARCH_EVENTS + """
        SELECT CASE event_id % 97 WHEN 0 THEN query WHEN 1 THEN '{"query":"  ","ts":' || ts_ms || '}'
               ELSE '{"ts":' || ts_ms || '}' END AS value
        FROM se WHERE event_id % 97 < 3""",
    "write_reduction": "WITH " + SEARCH_EVENTS + """,
        per AS (SELECT floor(ts_ms / 5000) AS f, query, count(*) AS n FROM se GROUP BY 1, 2)
        SELECT CAST(sum(n) AS BIGINT) AS events_received, CAST(count(*) AS BIGINT) AS rows_upserted,
               CAST(count(DISTINCT f) AS BIGINT) AS flushes,
               round(sum(n) / count(*), 6) AS events_per_row,
               round(sum(n) / count(DISTINCT f), 6) AS events_per_flush
        FROM per""",
    "sampled_counts": "WITH " + SEARCH_EVENTS + """
        SELECT query, CAST(count(*) * 4 AS BIGINT) AS est_count FROM se
        WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 4 = 0
        GROUP BY query""",
    "dedup_counts": "WITH " + SEARCH_EVENTS + """
        SELECT query, CAST(count(DISTINCT event_id) AS BIGINT) AS events FROM se GROUP BY query""",
    "prefix_weights": "WITH " + WEIGHTS + " SELECT p, w FROM weights",
    "prefix_cdf": "WITH " + WEIGHTS + " SELECT p, w, round(lo, 6) AS lo, round(cdf, 6) AS cdf FROM cdf",
    "weighted_sample": "WITH " + WEIGHTS + """,
        draws AS (SELECT event_id,
                         ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 AS u
                  FROM events)
        SELECT d.event_id, c.p FROM draws d ASOF LEFT JOIN cdf c ON d.u <= c.cdf""",
    "prefix_weights_json": "WITH " + WEIGHTS + """
        SELECT to_json(list(struct_pack(p := p, w := w) ORDER BY w DESC, p))::VARCHAR AS prefixes_json
        FROM weights""",
    "ring_assign": "WITH " + RING_KEYS + " SELECT prefix, node FROM assigned",
    "ring_share": "WITH " + RING_KEYS + """
        SELECT node, CAST(count(*) AS BIGINT) AS keys,
               round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM assigned GROUP BY node""",
    "ring_remap": "WITH " + RING_KEYS + """
        SELECT CAST(count(*) AS BIGINT) AS keys,
               CAST(sum(CASE WHEN a.node <> b.node THEN 1 ELSE 0 END) AS BIGINT) AS moved,
               round(avg(CASE WHEN a.node <> b.node THEN 1.0 ELSE 0.0 END), 6) AS moved_share,
               CAST(sum(CASE WHEN a.node <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS survivor_keys,
               CAST(sum(CASE WHEN a.node <> 2 AND a.node = b.node THEN 1 ELSE 0 END) AS BIGINT) AS survivor_kept
        FROM assigned a JOIN assigned2 b USING (prefix)""",
    "serving_export": "WITH " + EXPORT + """
        SELECT 'node-' || CAST(node AS VARCHAR) AS shard, prefix, key, value::VARCHAR AS value, ttl_s
        FROM export_owned""",
    "routing_report": "WITH " + EXPORT + REQUESTS + """,
        rr AS (SELECT request_id, norm AS prefix, 'suggest:v1:' || norm AS key,
                      ('0x' || substr(md5(norm), 1, 15))::BIGINT AS h FROM nreq),
        rro AS (SELECT rr.*, coalesce(r.node, (SELECT node FROM ring_first)) AS node
                FROM rr ASOF LEFT JOIN ring r ON rr.h <= r.pos)
        SELECT rro.request_id, rro.prefix, CAST(1 AS INTEGER) AS generation, rro.key,
               'node-' || CAST(rro.node AS VARCHAR) AS owner_node,
               CASE WHEN e.key IS NULL THEN 'MISS' ELSE 'HIT' END AS status
        FROM rro LEFT JOIN export e ON e.key = rro.key""",
    "export_read_back": "WITH " + EXPORT + """
        SELECT e.key, CAST(CASE WHEN torn THEN 0 ELSE n END AS INTEGER) AS n_suggestions,
               CASE WHEN torn THEN NULL ELSE top END AS first_query
        FROM (SELECT prefix, key, ('0x' || substr(md5(key), 1, 15))::BIGINT % 13 = 0 AS torn FROM export) e
        JOIN (SELECT prefix, count(*) AS n, min_by(query, rank) AS top FROM bidx GROUP BY prefix) USING (prefix)""",
    "latency_by_outcome": "WITH " + REQUEST_LOG + """
        SELECT outcome, CAST(count(*) AS BIGINT) AS requests,
               round(quantile_cont(latency_ms, 0.5), 6) AS p50,
               round(quantile_cont(latency_ms, 0.95), 6) AS p95,
               round(quantile_cont(latency_ms, 0.99), 6) AS p99
        FROM rl GROUP BY outcome
        UNION ALL
        SELECT 'ALL', CAST(count(*) AS BIGINT), round(quantile_cont(latency_ms, 0.5), 6),
               round(quantile_cont(latency_ms, 0.95), 6), round(quantile_cont(latency_ms, 0.99), 6)
        FROM rl""",
    "hit_rate": "WITH " + REQUEST_LOG + """
        SELECT CAST(count(*) AS BIGINT) AS requests,
               CAST(sum(CASE WHEN outcome = 'HIT' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
               round(avg(CASE WHEN outcome = 'HIT' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
        FROM rl""",
    "slo_gate": "WITH " + REQUEST_LOG + """,
        m AS (SELECT quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99,
                     avg(CASE WHEN outcome = 'HIT' THEN 1.0 ELSE 0.0 END) AS hr,
                     avg(CASE WHEN latency_ms >= 0 THEN 1.0 ELSE 0.0 END) AS ck FROM rl)
        SELECT 'p95_ms' AS metric, round(p95, 6) AS value, 25.0::DOUBLE AS threshold, p95 < 25.0 AS passed FROM m
        UNION ALL SELECT 'p99_ms', round(p99, 6), 60.0::DOUBLE, p99 < 60.0 FROM m
        UNION ALL SELECT 'hit_rate', round(hr, 6), 0.8::DOUBLE, hr > 0.8 FROM m
        UNION ALL SELECT 'checks', round(ck, 6), 0.99::DOUBLE, ck > 0.99 FROM m""",
    "latency_histogram": "WITH " + REQUEST_LOG + """
        SELECT outcome, CAST(CASE WHEN latency_ms < 1 THEN -1 ELSE floor(log2(latency_ms)) END AS INTEGER) AS bucket,
               CAST(count(*) AS BIGINT) AS requests
        FROM rl GROUP BY 1, 2""",
    "debounce": """
        WITH k AS (SELECT user_id AS session, event_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS value FROM events),
        l AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS nxt FROM k)
        SELECT session, event_id, ts_ms, value FROM l WHERE nxt IS NULL OR nxt - ts_ms >= 3600000""",
    "stream_fold": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM state""",
    "stream_dedup": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM state""",
    "compacted_catalog": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms FROM state""",
    "stream_trending": "WITH " + SEARCH_EVENTS + f"""
        SELECT query, round(sum(pow(0.5, ({AS_OF_MS} - ts_ms) / {H_MS})), 6) AS score
        FROM se GROUP BY query ORDER BY score DESC, query LIMIT 10""",
    "debounce_sessions": """
        WITH k AS (SELECT user_id AS session, event_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS value FROM events),
        l AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS nxt FROM k)
        SELECT session, event_id, ts_ms, value FROM l WHERE nxt IS NULL OR nxt - ts_ms >= 3600000""",
    "warm_prefixes": "WITH " + EXPORT + TOP_PREFIXES + """
        SELECT 'node-' || CAST(e.node AS VARCHAR) AS shard, e.prefix, e.key, e.ttl_s, w.w
        FROM export_owned e JOIN weights w ON w.p = e.prefix""",
    "index_publish": "WITH " + BLENDED_INDEX + f"""
        SELECT CAST(1 AS INTEGER) AS generation, CAST({AS_OF_MS} AS BIGINT) AS published_ms,
               (SELECT CAST(count(*) AS BIGINT) FROM bidx_cands) AS candidates,
               CAST(count(DISTINCT prefix) AS BIGINT) AS nodes, CAST(count(*) AS BIGINT) AS index_rows,
               (SELECT max(last_ms) FROM blended) AS max_event_ms,
               CAST({AS_OF_MS} - (SELECT max(last_ms) FROM blended) AS BIGINT) AS staleness_ms
        FROM bidx""",
    "index_incremental": "WITH " + BLENDED + """,
        left_over AS (SELECT * FROM blended WHERE ('0x' || substr(md5(query), 1, 15))::BIGINT % 97 <> 0)""" + _index("left_over", "nidx", 20000) + """
        SELECT prefix, rank, query, score FROM nidx""",
    "index_rollup": "WITH " + INDEX + " SELECT prefix, rank, query, score FROM idx",
    "prefix_scan_bulk": "WITH " + BASE_CATALOG + """,
        typed AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS request_id,
                         left(lower(regexp_split_to_array(text, '[ \\n]+')[1]), CAST(3 + turn % 6 AS BIGINT)) AS prefix FROM conversations),
        heads AS (SELECT query, all_time_count, left(query, n) AS prefix
                  FROM catalog, range(3, 9) r(n) WHERE length(query) >= n
                  UNION ALL SELECT query, all_time_count, left(query, n) FROM catalog, range(1, 3) r(n) WHERE length(query) >= n),
        each AS (SELECT prefix, count(*) AS n_queries, CAST(sum(all_time_count) AS BIGINT) AS searches,
                        first(query ORDER BY all_time_count DESC, query) AS best
                 FROM heads WHERE prefix IN (SELECT prefix FROM typed) GROUP BY prefix)
        SELECT request_id, t.prefix, coalesce(n_queries, 0) AS n_queries, CAST(coalesce(searches, 0) AS BIGINT) AS searches, best
        FROM typed t LEFT JOIN each e ON e.prefix = t.prefix WHERE t.prefix <> ''""",
    "stream_debounce": """
        WITH k AS (SELECT user_id AS session, event_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS value FROM events),
        d AS (SELECT *, CASE WHEN ts_ms < """ + AS_OF_MS + """ - 20 * 86400000 THEN 0 WHEN ts_ms < """ + AS_OF_MS + """ - 10 * 86400000 THEN 1
                             ELSE 2 END + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS part FROM k),
        newest AS (SELECT p.part, max(d.ts_ms) AS seen FROM (SELECT DISTINCT part FROM d) p JOIN d ON d.part < p.part GROUP BY p.part),
        judged AS (SELECT d.*, coalesce(ts_ms <= seen - 7200000, false) AS late FROM d LEFT JOIN newest USING (part)),
        l AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS nxt FROM judged WHERE NOT late)
        SELECT session, event_id, ts_ms, value, false AS late FROM l WHERE nxt IS NULL OR nxt - ts_ms >= 3600000
        UNION ALL SELECT session, event_id, ts_ms, value, true FROM judged WHERE late""",
    "ingest_metrics": "WITH " + SEARCH_EVENTS + """
        SELECT count(*) AS events, count(*) FILTER (event_id % 97 < 3) AS dead_letters, min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms
        FROM se""",
    "latency_sketch": "WITH " + REQUEST_LOG + """
        SELECT outcome, count(*) AS requests, true AS p50_near, true AS p95_near, true AS p99_near FROM rl GROUP BY outcome""",
    "top_terms_sketch": "WITH " + FOLDED + """
        SELECT q, cnt, cnt > 3.5 / 16384 * sum(cnt) OVER () AS certain FROM folded ORDER BY cnt DESC, q LIMIT 20""",
    "stream_resume": "WITH " + EVENT_STATE + """
        SELECT query, all_time_count, round(recent_score, 6) AS recent_score, last_ms, CAST(1 AS BIGINT) AS replayed FROM state""",
}
ORACLES["suggest_bucketed"] = ORACLES["suggest_bulk"]
ORACLES["compacted_partitions"] = ORACLES["upsert_overlap"]
ORACLES["stream_trending_state"] = ORACLES["stream_trending"]
