"""Filtered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import compile_filter
from .lookup import SCAN_LIMIT, SCAN_MOST, clamp, web_limit

#: Rows that the original looks at before it gives up, by command and over HTTP.
COMPAT_SCAN, COMPAT_SCAN_HTTP = 100_000, 10_000


def matching(docs: DataFrame, query: str | None, promoted: dict | None = None, compat: bool = False) -> DataFrame:
    """All documents that a filter matches; all rows without one."""
    return docs if not query else docs.where(compile_filter(query, F.col("v"), promoted, compat))


def filter_documents(docs: DataFrame, query: str, limit: int | None = None, promoted: dict | None = None, compat: bool = False, scan: int = COMPAT_SCAN) -> DataFrame:
    """The first matches by key.  ``compat`` looks at the first ``scan`` rows only."""
    pool = docs.orderBy("key").limit(scan) if compat else docs
    return matching(pool, query, promoted, compat).orderBy("key").limit(clamp(limit, SCAN_LIMIT, 1, SCAN_MOST))


def web_filter(docs: DataFrame, query: str, limit: str | int | None = None, promoted: dict | None = None, compat: bool = False) -> DataFrame:
    """filter_documents() by the web's rules: 1,000 at most; ``compat`` looks at the first COMPAT_SCAN_HTTP rows only."""
    pool = docs.orderBy("key").limit(COMPAT_SCAN_HTTP) if compat else docs
    return matching(pool, query, promoted, compat).orderBy("key").limit(web_limit(limit))
