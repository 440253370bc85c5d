"""Parameters of the suggestion pipeline.

Fixed values: these defaults must equal the ones the original service ships
with, otherwise catalogs, indexes and metrics come out different.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (must match the original defaults) ----------------------
TOP_N = 1_000_000            # rows kept by the offline fold
MAX_QUERIES = 300_000        # candidate cut before scoring, by all_time_count
MAX_SUGGESTIONS = 10         # K of the per-prefix top-K
WEIGHT_ALL_TIME = 1.0        # score = w1 * log1p(all_time_count) + w2 * recent_score
WEIGHT_RECENT = 1.0
HALF_LIFE_S = 21_600.0       # recency half-life, seconds
FLUSH_SIZE = 1_000           # flush when this many distinct queries are buffered
FLUSH_INTERVAL_MS = 5_000    # ... or when this much time passed since the last flush
TTL_BASE_S = 60              # cache TTL = base + uniform int in [0, jitter]
TTL_JITTER_S = 15
VNODES = 150                 # virtual nodes per cache node on the hash ring
CACHE_NODES = (0, 1, 2)      # node ids of the default three-node ring
KEY_PREFIX = "suggest:v"     # storage key = "suggest:v<generation>:<prefix>"
WEIGHT_PREFIX_LENGTHS = (2, 3)   # prefix lengths of the weighted prefix list
WEIGHT_PREFIX_LIMIT = 300        # rows of the weighted prefix list
WEIGHT_PREFIX_PATTERN = "^[a-z0-9]"
DEBOUNCE_MS = 140            # keystroke settle time of the search box
TRENDING_DISPLAY = 8         # trending entries shown
SLO_P95_MS = 25.0            # service-level thresholds
SLO_P99_MS = 60.0
SLO_HIT_RATE = 0.80
SLO_CHECKS = 0.99
# ---------------------------------------------------------------------------

# Our own choices (not from the original).
AS_OF = "2024-01-31 00:00:00"   # reference instant of the test data
SCORE_DIGITS = 6                # contract queries round doubles to this many digits
REQUEST_GAP_MS = 3_600_000      # keystroke-session gap for the test data (1 h)


@dataclass(frozen=True)
class IndexParams:
    max_queries: int = MAX_QUERIES
    k: int = MAX_SUGGESTIONS
    w_all_time: float = WEIGHT_ALL_TIME
    w_recent: float = WEIGHT_RECENT
    cut_by: str = "count"          # "count" (original) or "score"
    max_prefix_len: int | None = None
    decay_to_ms: int | None = None     # decay every recent_score to this instant before scoring
