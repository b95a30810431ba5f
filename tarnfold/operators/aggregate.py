"""Counts and statistics: single partial and final aggregates, without a limit on the rows that they see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import document, numeric
from .select import matching


def count_documents(docs: DataFrame, query: str | None = None, promoted: dict | None = None, compat: bool = False) -> DataFrame:
    """One row, ``n``; without a filter, values that aren't JSON count too."""
    return matching(docs, query, promoted, compat).agg(F.count("*").alias("n"))


def calc_stats(docs: DataFrame, field: str, query: str | None = None, promoted: dict | None = None, compat: bool = False) -> DataFrame:
    """One row: field, count, sum, avg, min and max of the numbers at a path, strings that are numbers included; zeros if there is none."""
    if promoted and field in promoted and promoted[field][1] != "string":
        x = promoted[field][0].cast("double")
    else:
        x = numeric(F.col("v"), field)
    values = matching(docs, query, promoted, compat).select(x.alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return values.agg(
        F.lit(field).alias("field"), F.count("x").alias("count"), zero(F.sum("x")).alias("sum"),
        zero(F.avg("x")).alias("avg"), zero(F.min("x")).alias("min"), zero(F.max("x")).alias("max"),
    )


def physical_stats(log: DataFrame) -> DataFrame:
    """One row on a log: versions, of them tombstones, distinct keys, the last sequence number and bytes of values."""
    return log.agg(
        F.count("*").alias("total_records"), F.count_if(F.col("op") != "PUT").alias("tombstones"),
        F.count_distinct("key").alias("keys"), F.max("seq").alias("last_seq"),
        F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("long").alias("value_bytes"),
    )


def log_audit(log: DataFrame) -> DataFrame:
    """One row on a log's soundness: rows, keys, values that aren't JSON, and versions that share a place with another."""
    places = log.groupBy("key", "seq", "batch_pos").agg(F.count("*").alias("n"), F.count_if((F.col("op") == "PUT") & document(F.col("raw")).isNull()).alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    keys = places.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") - 1).alias("extra"))
    return keys.agg(total("n").alias("rows"), F.count("*").alias("keys"), total("bad").alias("invalid_json"), total("extra").alias("doubled"))
