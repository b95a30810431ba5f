"""Continuously kept results, by Structured Streaming."""

from .board import BoardStream, live_scores, read_log, windowed_counts

__all__ = ["BoardStream", "live_scores", "read_log", "windowed_counts"]
