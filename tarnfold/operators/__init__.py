"""Operators on live documents: DataFrames of (key, raw, v) and, for leaderboards, (key, score)."""

from .aggregate import calc_stats, count_documents, log_audit, physical_stats
from .lookup import exists_count, find_by_label, key_labels, multi_get, point_get, range_scan, web_scan
from .ranking import around_key, around_score, rank_of_key, rank_range, rankings, score_at, score_range, scored, top_n, written
from .report import byte_size, percentiles, search
from .select import filter_documents, matching, web_filter

__all__ = [
    "around_key", "around_score", "calc_stats", "count_documents", "exists_count", "filter_documents", "find_by_label",
    "key_labels", "matching", "multi_get", "physical_stats", "point_get", "range_scan", "rank_of_key", "rank_range",
    "score_range", "scored", "top_n", "rankings", "byte_size", "percentiles", "search", "log_audit", "score_at", "web_filter", "web_scan", "written",
]
