"""What the operators share: words, shared storage, and small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import released, scratch, shared_folder, stored  # noqa: F401

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def new_folder(path: str) -> str:
    """A folder of its own below ``path``, for one write."""
    return f"{path}/{uuid.uuid4().hex}"


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders below ``path`` whose write has ended."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(of(path)):
        return []
    found = sorted(x.getPath().toString() for x in fs.listStatus(of(path)) if x.isDirectory())
    return [x for x in found if fs.exists(of(f"{x}/_SUCCESS"))]


def held_out_mod(n: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod n is the remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == remainder
