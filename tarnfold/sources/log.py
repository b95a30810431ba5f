"""The versioned log: every change is an appended row, and the newest version of a key counts.

    log: key, raw (null for deletes), seq, batch_pos, ts, op        op is PUT, DEL or DEL_WHERE
    ttl: key, expires_at                                            set apart from the documents

Rows of one batch share a ``seq`` and differ in ``batch_pos``.  A batch is one append job, so that it is
there as a whole or not at all.  Its number comes from a counter beside the log, which never falls, also when
rows go.  Documents are derived by one aggregation on the key, partial first; a compaction writes them back in the
order of keys, and what it leaves out, the newest deletes, to a folder of their own for streams that follow the log.

    path/log-000003     the rows          path/gone-000003    deletes that compactions have left out
    path/ttl            TTLs              path/seq, path/indexes, path/settings    markers
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import document, score, textual_score
from ..functions.values import allow_repeated_members
from .files import Counter, Folder, Markers, Numbers

#: Names of compression, in any case, and Parquet's; others count as the first, and tables have it unless told otherwise.
COMPRESSION = {"lz4": "lz4", "zstd": "zstd", "none": "uncompressed"}

SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("raw", T.StringType()), T.StructField("seq", T.LongType(), False),
    T.StructField("batch_pos", T.IntegerType()), T.StructField("ts", T.TimestampType()), T.StructField("op", T.StringType()),
])
TTL_SCHEMA = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("expires_at", T.TimestampType()), T.StructField("seq", T.LongType())])


def latest_versions(log: DataFrame) -> DataFrame:
    """(key, raw, seq, op) of the newest version of each key, tombstones included."""
    newest = F.max_by(F.struct("raw", "seq", "op"), F.struct("seq", F.coalesce("batch_pos", F.lit(0))))
    return log.groupBy("key").agg(newest.alias("newest")).select("key", "newest.raw", "newest.seq", "newest.op")


def current_documents(log: DataFrame) -> DataFrame:
    """(key, raw, v, seq) of keys whose newest version isn't a tombstone."""
    return latest_versions(log).where("op = 'PUT'").select("key", "raw", document(F.col("raw")).alias("v"), "seq")


def live_documents(docs: DataFrame, ttl: DataFrame | None, now: Column | None = None) -> DataFrame:
    """Those that haven't expired.  A TTL belongs to the key: writes and deletes leave it as it is."""
    if ttl is None:
        return docs
    now = F.current_timestamp() if now is None else now
    newest = ttl.groupBy("key").agg(F.max_by("expires_at", "seq").alias("expires_at"))
    return docs.join(newest.where(F.col("expires_at") <= now), "key", "left_anti")


def seconds_left(docs: DataFrame, ttl: DataFrame | None, now: Column | None = None) -> DataFrame:
    """(key, left) of live documents: the seconds that each has yet, -1 without a TTL."""
    if ttl is None:
        return docs.select("key", F.lit(-1).cast("long").alias("left"))
    now = F.current_timestamp() if now is None else now
    newest = ttl.groupBy("key").agg(F.max_by("expires_at", "seq").alias("expires_at"))
    left = F.unix_seconds(F.col("expires_at").cast("timestamp")) - F.unix_seconds(now)
    return live_documents(docs, ttl, now).join(newest, "key", "left").select("key", F.coalesce(left, F.lit(-1)).alias("left"))


def index_scores(log: DataFrame, path: str, created_seq: int = 0, textual: bool = False) -> DataFrame:
    """(key, score) as an index that is kept up by the original has it; ``textual`` also reads numbers as it does, without parsing.

    It ranks what was put after it was created; a put without a number leaves the old score; deletes by
    key remove it, deletes by a filter don't.
    """
    found = textual_score(F.col("raw"), path) if textual else score(document(F.col("raw")), path)
    rows = log.select("key", "seq", F.coalesce("batch_pos", F.lit(0)).alias("batch_pos"), "op", found.alias("score"))
    at = F.struct("seq", "batch_pos")
    deleted = rows.groupBy("key").agg(
        F.max(F.when(F.col("op") == "DEL", at)).alias("gone"),
        F.max(F.when((F.col("op") == "PUT") & F.col("score").isNotNull() & (F.col("seq") > created_seq), F.struct("seq", "batch_pos", "score"))).alias("put"),
    )
    alive = F.col("gone").isNull() | (F.struct("put.seq", "put.batch_pos") > F.col("gone"))
    return deleted.where(F.col("put").isNotNull() & alive).select("key", F.col("put.score").alias("score"))


class Log:
    """A log under a folder, with its TTLs and the registry of its indexes."""

    def __init__(self, spark: SparkSession, path: str, compression: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self.numbers = Counter(Folder(spark, f"{self.path}/seq"))
        #: Paths, and the last batch before each index was made.
        self.indexes = Numbers(Folder(spark, f"{self.path}/indexes"))
        self.settings = Markers(Folder(spark, f"{self.path}/settings"))
        self._compression = compression
        allow_repeated_members(spark)

    def set_compression(self, name: str) -> str:
        """What is written from now on is compressed so; an unknown name is the default.  Returns the name that holds."""
        self._compression = None
        known = name.strip().lower()
        self.settings["compression"] = known if known in COMPRESSION else "lz4"
        return self.compression()

    def compression(self) -> str:
        name = (self._compression or self.settings.get("compression", "lz4")).strip().lower()
        return name if name in COMPRESSION else "lz4"

    def _codec(self) -> str:
        return COMPRESSION[self.compression()]

    def _version(self) -> str | None:
        """The newest folder of log files: compaction writes a new one."""
        found = [n for n in self.folder.names() if n.startswith("log-")]
        done = [n for n in found if n == "log-000000" or self.folder.exists(f"{n}/_SUCCESS")]
        return done[-1] if done else None

    def create(self) -> None:
        if self._version() is None:
            self.spark.createDataFrame([], SCHEMA).write.parquet(f"{self.path}/log-000000")

    def exists(self) -> bool:
        return self._version() is not None

    def drop(self) -> None:
        if not self.exists():
            raise ValueError(f"no table at {self.path}")
        self.folder.drop()

    def truncate(self) -> None:
        """Clears data, TTLs and index registrations; batch numbers go on, as followers of the log may have seen the old ones."""
        last = self.last_seq()
        self.folder.drop()
        self.create()
        if last:
            self.numbers.take(last)

    def rows(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], SCHEMA)

    def ttl(self) -> DataFrame | None:
        at = f"{self.path}/ttl"
        return self.spark.read.schema(TTL_SCHEMA).parquet(at) if self.folder.exists("ttl") else None

    def last_seq(self) -> int:
        """The greatest number that a batch has had."""
        return self.numbers.last()

    def append(self, changes: DataFrame) -> int:
        """Appends (key, raw, op[, batch_pos]) as one batch; its number."""
        self.create()
        if not self.numbers.folder.exists():  # a log from before there was a counter
            self.numbers.take(self.rows().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0])
        place = F.col("batch_pos").cast("int") if "batch_pos" in changes.columns else F.lit(0)
        seq = self.numbers.take()
        rows = changes.select("key", F.col("raw").cast("string").alias("raw"), F.lit(seq).cast("long").alias("seq"), place.alias("batch_pos"), F.current_timestamp().alias("ts"), "op")
        rows.write.mode("append").option("compression", self._codec()).parquet(f"{self.path}/{self._version()}")
        return seq

    def put(self, items: Iterable[tuple[str, str | None]]) -> None:
        """Appends (key, raw) pairs as one batch; raw None deletes."""
        rows = [(k, raw, "PUT" if raw is not None else "DEL", i) for i, (k, raw) in enumerate(items)]
        self.append(self.spark.createDataFrame(rows, "key string, raw string, op string, batch_pos int"))

    def expire(self, key: str, at: Column) -> None:
        row = self.spark.createDataFrame([(key,)], "key string").select("key", at.alias("expires_at"), F.unix_micros(F.current_timestamp()).alias("seq"))
        row.write.mode("append").parquet(f"{self.path}/ttl")

    def documents(self, now: Column | None = None) -> DataFrame:
        return live_documents(current_documents(self.rows()), self.ttl(), now)

    def gone(self) -> DataFrame:
        """Deletes that compactions have left out."""
        found = [n for n in self.folder.names() if n.startswith("gone-") and self.folder.exists(f"{n}/_SUCCESS")]
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)

    def compact(self) -> None:
        """Rewrites the newest versions without tombstones, in the order of keys, into a new folder, and drops the old one.

        Tombstones of keys that are still gone are written beside it first: who follows the log may not have read them yet.
        """
        old = self._version()
        if old is None:
            return
        number = int(old[4:]) + 1
        rows, gone = compacted(self.rows())
        before = self.gone().join(self.rows().select("key"), "key", "left_anti")
        gone.unionByName(before).write.mode("overwrite").option("compression", self._codec()).parquet(f"{self.path}/gone-{number:06d}")
        sorted_ = rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite")
        sorted_.option("compression", self._codec()).option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/log-{number:06d}")
        self.folder.drop(old)
        for name in self.folder.names():
            if name.startswith("gone-") and name < f"gone-{number:06d}":
                self.folder.drop(name)

    def backup(self, target: str) -> str:
        """Copies the log's rows, TTLs and markers to a folder of their own below ``target``; restore() takes it."""
        out = f"{target.rstrip('/')}/{self.path.rsplit('/', 1)[-1]}-{uuid.uuid4().hex[:8]}"
        self.rows().write.option("compression", self._codec()).parquet(out)
        if (ttl := self.ttl()) is not None:
            ttl.write.parquet(f"{out}-ttl")
        marks = [("indexes", k, str(v)) for k, v in self.indexes.items()] + [("settings", k, v) for k, v in self.settings.items()] + [("seq", "last", str(self.last_seq()))]
        self.spark.createDataFrame(marks, "kind string, name string, value string").coalesce(1).write.parquet(f"{out}-marks")
        return out

    def restore(self, backup: str) -> None:
        """Makes this log, which must not exist, from a backup."""
        if self.exists():
            raise ValueError(f"there is a table at {self.path}")
        self.spark.read.schema(SCHEMA).parquet(backup).write.parquet(f"{self.path}/log-000000")
        if Folder(self.spark, f"{backup}-ttl").exists():
            self.spark.read.schema(TTL_SCHEMA).parquet(f"{backup}-ttl").write.parquet(f"{self.path}/ttl")
        for r in self.spark.read.parquet(f"{backup}-marks").collect():
            if r.kind == "seq":
                if int(r.value):
                    self.numbers.take(int(r.value))
            else:
                (self.indexes if r.kind == "indexes" else self.settings)[r.name] = r.value


def compacted(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a log that a compaction keeps, and the newest deletes, which it leaves out."""
    newest = latest_versions(log).select("key", "raw", "seq", F.lit(0).alias("batch_pos"), F.current_timestamp().alias("ts"), "op")
    return newest.where("op = 'PUT'"), newest.where("op <> 'PUT'")
