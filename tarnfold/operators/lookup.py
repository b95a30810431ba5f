"""Lookups and scans by key.  Tables sorted by key let row-group statistics skip most of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import key_of, label_of
from ..functions.values import LABELS, member, trimmed

SCAN_LIMIT, SCAN_MOST = 100, 10_000
#: The most that a scan or a filter over the web gives.
WEB_MOST = 1000


def shown(docs: DataFrame) -> DataFrame:
    """(uuid, data): the document, or a value that isn't JSON as a string."""
    return docs.select(F.col("key").alias("uuid"), F.coalesce("v", F.col("raw").cast("variant")).alias("data"))


def point_get(docs: DataFrame, key: str) -> DataFrame:
    """The row of a key; none if it is absent."""
    return docs.where(F.col("key") == key_of(key))


def _asked(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(i, key_of(k)) for i, k in enumerate(keys)], "pos int, key string")


def multi_get(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each asked key, in their order and as often as asked: pos, key, raw (null if absent).

    The keys come with the command, so their number is that of its words; they also prune the scan.
    """
    asked = _asked(docs, keys)
    found = docs.where(F.col("key").isin(sorted({key_of(k) for k in keys}))).select("key", "raw")
    return asked.join(found, "key", "left").select("pos", "key", "raw").orderBy("pos")


def exists_count(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row, ``n``: how many of the asked keys exist; a key that is asked twice counts twice."""
    found = docs.where(F.col("key").isin(sorted({key_of(k) for k in keys}))).select("key")
    return _asked(docs, keys).join(found, "key", "left_semi").agg(F.count("*").alias("n"))


def clamp(limit: int | None, default: int, least: int, most: int | None) -> int:
    n = default if limit is None else max(limit, least)
    return n if most is None else min(n, most)


def range_scan(docs: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, most: int = SCAN_MOST) -> DataFrame:
    """Documents from ``start`` to ``end``, both included, in the order of keys.  None, "-", "min", "+" and "max" leave a side open."""
    low = None if start in (None, "-", "min") else key_of(start)
    high = None if end in (None, "+", "max") else key_of(end)
    if low is not None:
        docs = docs.where(F.col("key") >= low)
    if high is not None:
        docs = docs.where(F.col("key") <= high)
    return docs.orderBy("key").limit(clamp(limit, SCAN_LIMIT, 1, most))


def web_limit(limit: str | int | None) -> int:
    """100 unless it is a number, and 1,000 at most; unlike a command's, 0 gives none."""
    text = str(limit)
    return min(int(text), WEB_MOST) if text.isascii() and text.isdigit() else SCAN_LIMIT


def web_scan(docs: DataFrame, start: str | None = None, end: str | None = None, limit: str | int | None = None) -> DataFrame:
    """range_scan() by the web's rules: blank bounds are passed over, and "-" and the like are keys as any other text is."""
    if start and start.strip():
        docs = docs.where(F.col("key") >= key_of(start))
    if end and end.strip():
        docs = docs.where(F.col("key") <= key_of(end))
    return docs.orderBy("key").limit(web_limit(limit))


def scan_arguments(words: list[str]) -> tuple[str | None, str | None, int | None]:
    """(start, end, limit) of a scan command's words: one is a limit if it is an integer, else a start; of two, an integer second one is a limit."""
    integer = lambda w: w.isascii() and w.isdigit()
    if len(words) == 1:
        return (None, None, int(words[0])) if integer(words[0]) else (words[0], None, None)
    if len(words) == 2:
        return (words[0], None, int(words[1])) if integer(words[1]) else (words[0], words[1], None)
    if len(words) > 2:
        return words[0], words[1], int(words[2]) if integer(words[2]) else None
    return None, None, None


def key_labels(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(uuid, label) in the order of keys; 5,000 unless asked otherwise, and 50,000 at most."""
    rows = docs.orderBy("key").limit(clamp(limit, 5_000, 1, 50_000))
    return rows.select(F.col("key").alias("uuid"), label_of(F.col("v"), F.col("key"), F.col("raw")).alias("label"))


def names(v: Column, term: str) -> Column:
    """Whether any labelling member equals the term, without regard to case and outer spaces."""
    wanted = term.strip().lower()
    found = F.lit(False)
    for name in LABELS:
        found = found | F.coalesce(F.lower(trimmed(member(v, name).string)) == wanted, F.lit(False))
    return found


def find_by_label(docs: DataFrame, term: str, scan: int | None = 10_000) -> DataFrame:
    """The row of a key or, if there is none, the first (by key) among ``scan`` rows that is labelled so; ``scan`` None looks through all."""
    exact = point_get(docs, term).withColumn("_place", F.lit(0))
    pool = docs if scan is None else docs.orderBy("key").limit(scan)
    named = pool.where(names(F.col("v"), term)).orderBy("key").limit(1).withColumn("_place", F.lit(1))
    return exact.unionByName(named).orderBy("_place").limit(1).drop("_place")
