"""For people: sizes, a search over everything, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import label_of
from ..shared import released, stored
from .ranking import score_at


def byte_size(n: Column) -> Column:
    """A number of bytes with its unit: two decimals from a kilobyte on."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = F.lit(1024**power)
        out = F.when(n >= size, F.concat(F.format_string("%.2f", n.cast("double") / size), F.lit(f" {unit}"))).otherwise(out)
    return out


def search(docs: DataFrame, term: str) -> DataFrame:
    """(uuid, label, raw) of documents whose label, key or text contains the term, in any case."""
    rows = docs.select(F.col("key").alias("uuid"), label_of(F.col("v"), F.col("key"), F.col("raw")).alias("label"), "raw")
    wanted, found = term.strip().lower(), F.lit(False)
    for c in ("label", "uuid", "raw"):
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return rows.where(found)


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: avg, min, max, p50, p90 and p99, each percentile p the value at place floor(n * p) in order; zeros if there is none.

    Exact without holding all values anywhere: each is found as a rank is, between counted values.
    """
    x = F.col(column).cast("double")
    values = stored(df.select(x.alias("score"), F.lit("").alias("key")).where("score IS NOT NULL"), "values")
    row = values.agg(*[F.coalesce(f("score"), F.lit(0.0)).alias(n) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))], F.count("*").alias("n")).first()
    found = {f"p{k}": score_at(values, row["n"] - min(row["n"] - 1, int(row["n"] * k / 100))) if row["n"] else 0.0 for k in (50, 90, 99)}
    released(values)
    return df.sparkSession.createDataFrame([(row["avg"], row["min"], row["max"], *found.values())], "avg double, min double, max double, p50 double, p90 double, p99 double")
