"""Tables that a computation writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a local session may do without the setting; it then gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "tarnfold-checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the engine may have gone
        of = spark._jvm.org.apache.hadoop.fs.Path
        of(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(of(path), True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends in files that outlive executors.

    The files go when the driver ends, or by released().
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/session-{_SESSION}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scratch.get() is not None:
        _scratch.get().append(out)
    return out


_folders: set[str] = set()
_scratch: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch():
    """Tables that are stored within go at its end, but for those that are given to what it yields."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    token = _scratch.set([])
    try:
        yield keep
    finally:
        made = _scratch.get()
        _scratch.reset(token)
        for df in made:
            if df._stored_at not in kept:
                released(df)
            elif _scratch.get() is not None:
                _scratch.get().append(df)


def is_stored(df: DataFrame) -> bool:
    return hasattr(df, "_stored_at")


def released(df: DataFrame) -> None:
    """Deletes the files of a table from stored() that nothing will read again; leaves any other."""
    if is_stored(df):
        _drop(df.sparkSession, df._stored_at)
