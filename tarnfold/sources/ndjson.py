"""NDJSON in and out: a line is {"uuid": key, "data": document}, or a document with its key in ``uuid``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_key, document, member


def lines_to_changes(lines: DataFrame) -> DataFrame:
    """(key, raw, op) from a column ``value``; lines that aren't JSON or have no key are skipped.

    Read as text, not by the JSON reader, which would lose the difference of null and missing.
    """
    def change(v: Column) -> Column:
        data = F.try_variant_get(v, "$.data", "variant")
        raw = F.when(data.isNotNull(), F.to_json(data)).otherwise(F.col("value"))
        return F.struct(canonical_key(member(v, "uuid").string).alias("key"), raw.alias("raw"), F.lit("PUT").alias("op"))

    # one generator, as a filter on the key would be pushed below and parse every line again
    parsed = F.transform(F.array(document(F.col("value"))), change)
    return lines.select(F.inline(F.filter(parsed, lambda c: c["key"].isNotNull())))


def import_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return lines_to_changes(spark.read.text(path))


def export_ndjson(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents as lines (``value``), in the order of keys; written as text if there is a path."""
    data = F.coalesce("v", F.col("raw").cast("variant"))
    lines = docs.orderBy("key").select(F.concat(F.lit('{"uuid":"'), F.col("key"), F.lit('","data":'), F.to_json(data), F.lit("}")).alias("value"))
    if path:
        lines.write.text(path)
    return lines


def documents_of_events(events: DataFrame) -> DataFrame:
    """(key, raw, v) of an event table, every event a document.

    Members are left out or of another type by fixed rules of the id, as in loosely kept JSON: no value if
    7 divides it, a null value if 11 does, a value in quotes if 13 does (the first that applies).
    """
    n = F.col("event_id")
    number = F.format_string("%.2f", F.col("value"))
    value: Column = F.when(n % 7 == 0, "").when(n % 11 == 0, ',"value":null').when(n % 13 == 0, F.concat(F.lit(',"value":"'), number, F.lit('"'))).otherwise(F.concat(F.lit(',"value":'), number))
    tags = F.concat(F.lit(',"tags":["t'), (n % 5).cast("string"), F.lit('","'), F.col("event_type"), F.lit('"]'))
    raw = F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit(',"props":'), F.col("props"), tags, value, F.lit("}"))
    key = canonical_key(F.concat(F.lit("event:"), n.cast("string")))
    return events.select(key.alias("key"), raw.alias("raw")).withColumn("v", document(F.col("raw")))
