"""cmdlens: command-log analytics on Spark.

Ingest commands or tool calls, keep the latest record per distinct command,
index byte trigrams, search with ranking and local-to-global fallback, match
phrases exactly or with typos, filter noise, resolve short hash prefixes,
prune, and compute usage statistics -- every operator a DataFrame -> DataFrame
function built from native Spark SQL expressions.
"""

__version__ = "0.1.0"

from .operators.hashlet import min_hashlet_len, resolve_prefixes  # noqa: E402
from .operators.index import build_index, gram_doc_freq  # noqa: E402
from .operators.ingest import ingest, merge_history, meta_map, meta_table  # noqa: E402
from .operators.maintenance import (mark_prune, prune_apply, prune_candidates,  # noqa: E402
                                    prune_count, unmark_prune)
from .operators.squelch import DEFAULT_SQUELCH, active_list, compile_patterns, squelch  # noqa: E402
from .operators.stats import (activity_heatmap, daily_distribution, hourly_distribution,  # noqa: E402
                              overview, stats_all, stats_base, top_list, top_list_view)
from .plans.commands import (batch_search, cat, filtered_history, find, history, hit_view,  # noqa: E402
                             keyword_queries, resolve_prefix, tool_history)
from .session import configure, local_session  # noqa: E402

__all__ = [
    "activity_heatmap", "active_list", "batch_search", "build_index", "cat", "compile_patterns",
    "configure", "daily_distribution", "DEFAULT_SQUELCH", "filtered_history", "find",
    "gram_doc_freq", "history", "hit_view", "hourly_distribution", "ingest", "keyword_queries",
    "local_session", "mark_prune", "merge_history", "meta_map", "meta_table", "min_hashlet_len",
    "overview", "prune_apply", "prune_candidates", "prune_count", "resolve_prefix",
    "resolve_prefixes", "squelch", "stats_all", "stats_base", "tool_history", "top_list",
    "top_list_view", "unmark_prune",
]
