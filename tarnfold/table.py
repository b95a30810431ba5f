"""Tables and a session of commands, on top of the operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .edits import literal_value, set_member
from .functions import key_of
from .plans.commands import Command, CommandError, parse_command
from .sources.files import Folder, Markers
from .sources.log import COMPRESSION, Log, current_documents, index_scores, seconds_left
from .sources.ndjson import export_ndjson, import_ndjson


class Table:
    """A named table of documents.  Queries return DataFrames; changes append to its log.

    ``compat`` ranks as an index that is kept up put by put, and limits filters to the first rows.
    ``now`` stands for the current time, if given.
    """

    def __init__(self, spark: SparkSession, path: str, compat: bool = False, now: Column | None = None, compression: str | None = None):
        self.spark, self.compat, self.now = spark, compat, now
        self.log = Log(spark, path, compression)

    def documents(self) -> DataFrame:
        return self.log.documents(self.now)

    def board(self, path: str) -> DataFrame:
        if self.compat:
            if path not in self.log.indexes:
                raise CommandError(f"no index on {path}")
            return index_scores(self.log.rows(), path, self.log.indexes[path], textual=True)
        return ops.scored(self.documents(), path)

    # changes
    def set(self, key: str, raw: str) -> None:
        self.log.put([(key_of(key), raw)])

    def mset(self, items: Iterable[tuple[str, str | None]]) -> None:
        """All at once; None deletes."""
        self.log.put([(key_of(k), raw) for k, raw in items])

    def json_set(self, key: str, path: str, value: Any) -> None:
        found = ops.point_get(self.documents(), key).select("raw").first()
        self.set(key, set_member(found["raw"] if found else None, path, value))

    def delete(self, key: str) -> int:
        """1, whether the key was there or not."""
        self.log.put([(key_of(key), None)])
        return 1

    def delete_where(self, query: str) -> int:
        """Deletes all matches in one batch; how many there were."""
        gone = ops.matching(self.documents(), query).select("key", F.lit(None).cast("string").alias("raw"), F.lit("DEL_WHERE").alias("op"))
        seq = self.log.append(gone)
        return self.log.rows().where((F.col("seq") == seq) & (F.col("op") == "DEL_WHERE")).count()

    def expire(self, key: str, seconds: int) -> int:
        """1 if the key exists, else 0."""
        if not ops.point_get(self.documents(), key).limit(1).count():
            return 0
        now = F.current_timestamp() if self.now is None else self.now
        self.log.expire(key_of(key), F.timestamp_seconds(F.unix_seconds(now) + seconds))
        return 1

    def ttl(self, key: str) -> int:
        """Seconds left; -1 without a TTL, -2 if the key is absent or expired."""
        row = seconds_left(ops.point_get(current_documents(self.log.rows()), key), self.log.ttl(), self.now).first()
        return row["left"] if row else -2

    def load(self, path: str) -> None:
        self.log.append(import_ndjson(self.spark, path))

    def dump(self, path: str) -> None:
        export_ndjson(self.documents(), path)

    # queries
    def get(self, key: str) -> DataFrame:
        return ops.lookup.shown(ops.point_get(self.documents(), key))

    def mget(self, keys: list[str]) -> DataFrame:
        return ops.multi_get(self.documents(), keys)

    def exists(self, keys: list[str]) -> DataFrame:
        return ops.exists_count(self.documents(), keys)

    def scan(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return ops.lookup.shown(ops.range_scan(self.documents(), start, end, limit))

    def filter(self, query: str, limit: int | None = None) -> DataFrame:
        return ops.lookup.shown(ops.filter_documents(self.documents(), query, limit, compat=self.compat))

    def count(self, query: str | None = None) -> DataFrame:
        return ops.count_documents(self.documents(), query, compat=self.compat)

    def calc_stats(self, field: str, query: str | None = None) -> DataFrame:
        return ops.calc_stats(self.documents(), field, query, compat=self.compat)

    def stats(self) -> DataFrame:
        return ops.physical_stats(self.log.rows())

    def keys(self, limit: int | None = None) -> DataFrame:
        return ops.key_labels(self.documents(), limit)

    def web_scan(self, start: str | None = None, end: str | None = None, limit: str | int | None = None) -> DataFrame:
        return ops.lookup.shown(ops.web_scan(self.documents(), start, end, limit))

    def web_filter(self, query: str, limit: str | int | None = None) -> DataFrame:
        return ops.lookup.shown(ops.web_filter(self.documents(), query, limit, compat=self.compat))

    def find(self, term: str) -> DataFrame:
        return ops.lookup.shown(ops.find_by_label(self.documents(), term, scan=10_000 if self.compat else None))

    def top(self, path: str, limit: int | None = None) -> DataFrame:
        return ops.top_n(self.board(path), limit)

    def rank(self, path: str, key: str) -> DataFrame:
        return ops.rank_of_key(self.board(path), key)

    def around_key(self, path: str, key: str, limit: int | None = None) -> DataFrame:
        return ops.around_key(self.board(path), key, limit)

    def around_score(self, path: str, score: float, limit: int | None = None) -> DataFrame:
        return ops.around_score(self.board(path), score, limit)

    def score_range(self, path: str, low: float, high: float, limit: int | None = None) -> DataFrame:
        return ops.score_range(self.board(path), low, high, limit)

    def rank_range(self, path: str, first: int, last: int) -> DataFrame:
        return ops.rank_range(self.board(path), first, last)

    def audit(self) -> DataFrame:
        """One row on the log's soundness: rows, keys, values that aren't JSON, versions that share a place."""
        return ops.log_audit(self.log.rows())


def _within(low: float, high: float | None = None):
    return lambda x: max(low, x if high is None else min(x, high))


#: Settings: default, type, and what holds them in range.  What they stand for in an engine of its own, threads and caches, is Spark's here.
SETTINGS: dict[str, tuple] = {
    "compaction_trigger": (4, int, _within(2)),  # files of a table from which maintain() compacts it
    "compression": ("lz4", lambda x: x.lower() if x.lower() in COMPRESSION else "lz4", lambda x: x),  # of tables that are made from then on
}


class Session:
    """Runs command lines against the tables under a folder.  MULTI queues commands until EXEC, which runs them in order."""

    def __init__(self, spark: SparkSession, root: str, compat: bool = False, now: Column | None = None):
        self.spark, self.root, self.compat, self.now = spark, root.rstrip("/"), compat, now
        self.tables: dict[str, Table] = {}
        self.queue: list[Command] | None = None

    def table(self, name: str, create: bool = False) -> Table:
        t = self.tables.get(name) or Table(self.spark, f"{self.root}/{name}", self.compat, self.now)
        if not t.log.exists():
            if not create:
                raise CommandError(f"no table {name}")
            t.log.create()
            if (chosen := self.config()["compression"]) != t.log.compression():
                t.log.set_compression(chosen)
        self.tables[name] = t
        return t

    def names(self) -> list[str]:
        found = Folder(self.spark, self.root)
        return [n for n in found.folders() if Log(self.spark, f"{self.root}/{n}").exists()]

    def config(self) -> dict[str, Any]:
        """The settings of the tables under the folder, with their defaults."""
        kept = Markers(Folder(self.spark, f"{self.root}/_settings"))
        return {k: type_(kept.get(k, default)) for k, (default, type_, _) in SETTINGS.items()}

    def configure(self, **changes: Any) -> dict[str, Any]:
        """Changes settings; a value that can't be read leaves its setting, one out of range is moved into it.  Unknown names are errors."""
        kept = Markers(Folder(self.spark, f"{self.root}/_settings"))
        for name, value in changes.items():
            if name not in SETTINGS:
                raise CommandError(f"no setting {name}")
            _, type_, within = SETTINGS[name]
            with contextlib.suppress(ValueError):
                kept[name] = str(within(type_(str(value).strip())))
        return self.config()

    def metrics(self) -> DataFrame:
        """(metric, table, value): what a monitor asks for, of each table and of all (table null)."""
        rows = [("up", None, 1.0)]
        total = 0
        for name in self.names():
            log = self.table(name).log
            files, size = Folder(self.spark, f"{log.path}/{log._version()}").bytes()
            stats = self.table(name).stats().first()
            rows += [(m, name, float(x)) for m, x in (("table_records", stats["total_records"]), ("table_keys", stats["keys"]), ("table_tombstones", stats["tombstones"]), ("table_files", files), ("table_disk_bytes", log.folder.bytes()[1]))]
            total += log.folder.bytes()[1]
        rows.append(("total_disk_bytes", None, float(total)))
        rows.append(("shuffle_partitions", None, float(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return self.spark.createDataFrame(rows, "metric string, table string, value double")

    def details(self) -> DataFrame:
        """(table, total_records, tombstones, keys, last_seq, value_bytes, size) of all tables, by name."""
        rows = [(n, *self.table(n).stats().first()) for n in self.names()]
        out = self.spark.createDataFrame(rows, "table string, total_records long, tombstones long, keys long, last_seq long, value_bytes long")
        return out.withColumn("size", ops.byte_size(F.col("value_bytes"))).orderBy("table")

    def maintain(self) -> list[str]:
        """Compacts the tables that have come to as many files as the setting says; their names."""
        most, done = self.config()["compaction_trigger"], []
        for name in self.names():
            log = self.table(name).log
            if sum(n.endswith(".parquet") for n in Folder(self.spark, f"{log.path}/{log._version()}").names()) >= most:
                log.compact()
                done.append(name)
        return done

    def run(self, line: str) -> Any:
        """A DataFrame, a number, a text, or a list of those from EXEC."""
        c = parse_command(line)
        if c.verb == "MULTI":
            self.queue = []
            return "OK"
        if c.verb == "DISCARD":
            self.queue = None
            return "OK"
        if c.verb == "EXEC":
            queued, self.queue = self.queue, None
            if queued is None:
                raise CommandError("EXEC without MULTI")
            return self._transaction(queued)
        if self.queue is not None:
            self.queue.append(c)
            return "QUEUED"
        return self._run(c)

    def _transaction(self, queued: list[Command]) -> list[Any]:
        """In order; puts and deletes that stand together on one table are one batch, so one append."""
        out, k = [], 0
        writes = ("SET", "MSET", "DEL")
        while k < len(queued):
            c = queued[k]
            if c.verb not in writes:
                out.append(self._run(c))
                k += 1
                continue
            batch, first = [], k
            while k < len(queued) and queued[k].verb in writes and queued[k].table == c.table:
                q = queued[k].args
                batch += q["items"] if queued[k].verb == "MSET" else [(q["key"], q.get("raw"))]
                k += 1
            self.table(c.table).mset(batch)
            out += [1 if q.verb == "DEL" else "OK" for q in queued[first:k]]
        return out

    def _run(self, c: Command) -> Any:
        a, v = c.args, c.verb
        if v == "PING":
            return "PONG"
        if v == "QUIT":
            return "OK"
        if v == "AUTH":
            raise CommandError("AUTH is not supported: who may connect is the business of Spark's deployment")
        if v == "METRICS":
            return self.metrics()
        if v == "CONFIG GET":
            return self.config()
        if v == "CONFIG SET":
            return self.configure(**{a["name"]: a["value"]})
        if v == "TABLES":
            return self.names()
        if v in ("FLUSH", "BACKUP") and c.table is None:
            return [self.table(n).log.backup(a.get("target", f"{self.root}-backup")) for n in self.names()] if v == "BACKUP" else "OK"
        if v == "FLUSH":  # every batch is committed as it is appended
            return "OK"
        if v == "STATS":
            return self.table(c.table).stats() if c.table else [(n, self.table(n).stats()) for n in self.names()]
        if v == "INDEX LIST":
            return sorted(self.table(c.table).log.indexes) if c.table in self.names() else []
        t = self.table(c.table, create=v in ("CREATE", "SET", "MSET", "JSON.SET", "INDEX CREATE"))
        if v == "CREATE":
            return "OK"
        if v in ("DROP", "TRUNCATE"):
            (t.log.drop if v == "DROP" else t.log.truncate)()
            if v == "DROP":
                self.tables.pop(c.table)
            return "OK"
        if v == "INDEX CREATE":
            t.log.indexes.setdefault(a["path"], t.log.last_seq())
            return "OK"
        if v == "COMPRESSION":
            return t.log.set_compression(a["type"])
        if v == "JSON.SET":
            return t.json_set(a["key"], a["path"], literal_value(a["value"])) or "OK"
        if v == "SCAN":
            return t.scan(*ops.lookup.scan_arguments(a["words"]))
        run = {
            "SET": t.set, "MSET": t.mset, "DEL": t.delete, "DEL_WHERE": t.delete_where, "GET": t.get, "MGET": t.mget, "EXISTS": t.exists,
            "EXPIRE": t.expire, "TTL": t.ttl, "FILTER": t.filter, "COUNT": t.count, "CALC_STATS": t.calc_stats, "TOP": t.top, "RANK": t.rank,
            "RANK.KEY": t.around_key, "RANK.SCORE": t.around_score, "RANK.RANGE_SCORE": t.score_range, "RANK.RANGE": t.rank_range,
        }[v]
        out = run(**a)
        return "OK" if out is None else out
