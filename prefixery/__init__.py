"""Query-suggestion analytics on Spark: catalog fold, recency, prefix index,
bulk lookup, prefix weights, consistent-hash sharding, streaming ingest and
workload metrics.

The building blocks take and return DataFrames::

    from prefixery import (build_session, fold_query_log, catalog_top_n, to_catalog,
                           decayed_state, upsert, candidates, build_index,
                           nested_index, suggest_bulk)
"""

from .config import IndexParams
from .operators.fold import catalog_top_n, fold_query_log, to_catalog
from .operators.lookup import suggest_bulk, trending
from .operators.prefix_index import build_index, candidates, nested_index
from .operators.recency import decayed_state, merge_states, upsert
from .session import build_session

__version__ = "0.1.0"

__all__ = ["IndexParams", "build_index", "build_session", "candidates", "catalog_top_n",
           "decayed_state", "fold_query_log", "merge_states", "nested_index", "suggest_bulk",
           "to_catalog", "trending", "upsert"]
