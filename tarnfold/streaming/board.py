"""A board of scores that follows a log.

The stream keeps one row per key: its newest score, and whether it is deleted.  Each micro-batch is
aggregated to one row per key, merged with the state by key, and written as the state's next version; a
version is only read once it is complete.  What is newest is told by batch numbers of the log, so that a batch
that is run again, or a stream that starts again from a new checkpoint, changes nothing.  Ranks are batch
queries on the state.

The whole state is rewritten with every batch; live_scores() keeps it in Spark's state store instead, for
boards that are much larger than the changes to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import document, score
from ..sources.files import Folder
from ..sources.log import SCHEMA

STATE = "key string, score double, seq long, batch_pos int"


def read_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The rows of the log under ``path`` as they come.

    A compaction's rows come once more, with the numbers that they had, and so do the deletes that it left out;
    files that it has dropped meanwhile are passed over.
    """
    reader = spark.readStream.schema(SCHEMA).option("ignoreMissingFiles", "true")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path.rstrip('/')}/{{log,gone}}-*")


def newest_scores(log: DataFrame, path: str) -> DataFrame:
    """(key, score, seq, batch_pos) of the newest version of each key; score null for deleted or unscored ones."""
    s = F.when(F.col("op") == "PUT", score(document(F.col("raw")), path))
    rows = log.select("key", s.alias("score"), "seq", F.coalesce("batch_pos", F.lit(0)).alias("batch_pos"))
    return _newest(rows)


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("score", "seq", "batch_pos"), F.struct("seq", "batch_pos"))
    return rows.groupBy("key").agg(newest.alias("n")).select("key", "n.*")


class BoardStream:
    def __init__(self, spark: SparkSession, state: str, path: str):
        self.spark, self.state, self.path = spark, state.rstrip("/"), path
        self.folder = Folder(spark, self.state)

    def _versions(self) -> list[int]:
        found = self.folder.names()
        return sorted(int(n[1:]) for n in found if n.startswith("v") and self.folder.exists(f"{n}/_SUCCESS"))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        versions = self._versions()
        rows = newest_scores(batch, self.path)
        if versions:
            rows = _newest(self.spark.read.schema(STATE).parquet(f"{self.state}/v{versions[-1]}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.state}/v{versions[-1] + 1 if versions else 0}")
        for v in versions[:-1]:
            self.folder.drop(f"v{v}")

    def start(self, log: DataFrame, checkpoint: str, **trigger):
        return log.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def board(self) -> DataFrame:
        """(key, score) as of the last complete batch, for the ranking operators."""
        versions = self._versions()
        rows = self.spark.read.schema(STATE).parquet(f"{self.state}/v{versions[-1]}") if versions else self.spark.createDataFrame([], STATE)
        return rows.where("score is not null").select("key", "score")


LIVE = "key string, score double, seq long, batch_pos int, live boolean"


def live_scores(log: DataFrame, path: str, seconds: int) -> DataFrame:
    """Streaming: LIVE rows of the keys that change, by keyed state with a time to live.

    A key's newest score is kept in the state store until ``seconds`` of event time (``ts``) have gone by without a
    change to it; then, or once it is deleted, it comes as a row that isn't live, and its state goes.  Spark runs the
    function on Arrow batches, a call for each key that has changed; needs output mode update.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    s = F.when(F.col("op") == "PUT", score(document(F.col("raw")), path))
    rows = log.withWatermark("ts", "0 seconds").select("key", s.alias("score"), "seq", F.coalesce("batch_pos", F.lit(0)).alias("batch_pos"), "ts")

    def follow(key, parts, state: GroupState):
        old = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], old[0], old[1], old[2], False)], columns=["key", "score", "seq", "batch_pos", "live"])
            return
        newest, latest = old and (old[1], old[2], old[0], old[3]), 0
        for part in parts:
            for r in part.itertuples():
                row = (int(r.seq), int(r.batch_pos), None if pd.isna(r.score) else float(r.score), int(r.ts.timestamp() * 1000))
                newest = row if newest is None or row[:2] > newest[:2] else newest
        latest = newest[3]
        if newest[2] is None:
            if state.exists:
                state.remove()
            gone = old[0] if old else None
            if gone is not None:
                yield pd.DataFrame([(key[0], gone, newest[0], newest[1], False)], columns=["key", "score", "seq", "batch_pos", "live"])
            return
        state.update((newest[2], newest[0], newest[1], latest))
        state.setTimeoutTimestamp(max(latest + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if old is None or newest[:2] != (old[1], old[2]):
            yield pd.DataFrame([(key[0], newest[2], newest[0], newest[1], True)], columns=["key", "score", "seq", "batch_pos", "live"])

    return rows.groupBy("key").applyInPandasWithState(follow, LIVE, "score double, seq long, batch_pos int, ts long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events per window and key, final once they are ``late`` behind the newest; works on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
