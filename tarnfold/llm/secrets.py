"""Secret scans over versions of files, by an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256.  The ledger holds (blob, rule version, spans); only
pairs that it lacks are scanned, each once, however many paths share the blob, and findings are joined
back to all paths.  The rule version is a digest of the rules themselves, so that changed rules scan every
blob once again, and nobody has to remember it.

The ledger lives in the shared folder, and outlives sessions: a folder for each rule version, in it one for
each scan, which counts once its _SUCCESS is there.  So a scan that fails leaves nothing, and two at once do
no harm: they may both scan a blob, with the same spans, of which the reader takes one.

All of it is DataFrame expressions.  Defined results: a null text is an empty blob without findings; a very
long text is scanned as a whole; repeated rows and ties of doc_id get the findings of their own texts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import complete_folders, new_folder, scratch, shared_folder, stored, table, whole_text
from .spans import listed, matches, ranked, sha256

KINDS = ["assign", "access", "hex", "pem"]
#: Matches of the first three are dropped if they are too short; dropping is left to the pattern where no shorter match can be inside.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PEM = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
MIN_VALUE = 6
#: New blobs up to which their digests are broadcast.
FEW = 100_000


def secret_spans(text: Column) -> Column:
    """Sorted array<struct<start, kind, end>> of a text."""
    assign = F.filter(matches(text, ASSIGN, text.rlike(ASSIGN)), lambda s: F.char_length(F.regexp_extract(s["m"], ASSIGN, 2)) >= MIN_VALUE)
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = matches(text, HEX, text.rlike(HEX))
    pem = matches(text, PEM, F.contains(text, F.lit("PRIVATE KEY-----")))
    return F.sort_array(F.concat(ranked(assign, 0), ranked(access, 1), ranked(hexes, 2), ranked(pem, 3)))


def rule_version() -> str:
    """A digest of all that decides what is found, and of how it is told."""
    rules = repr((KINDS, ASSIGN, ACCESS, HEX, PEM, MIN_VALUE))
    return hashlib.sha256(rules.encode()).hexdigest()[:16]


LEDGER = "blob string, version string, spans array<struct<start:int,kind:int,end:int>>"


class Ledger:
    """The scans of all blobs so far, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, version: str | None = None):
        self.spark, self.version = spark, version or rule_version()
        self.path = f"{path or shared_folder(spark) + '/secrets-ledger'}/version={self.version}"

    def rows(self) -> DataFrame:
        """(blob, version, spans), a row for each blob."""
        found = complete_folders(self.spark, self.path)
        if not found:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(*found)
        return rows if len(found) == 1 else rows.groupBy("blob").agg(F.first("version").alias("version"), F.first("spans").alias("spans"))

    def extend(self, docs: DataFrame) -> DataFrame:
        """Scans the blobs of ``docs`` (text) that are not in it under these rules; returns rows() with them."""
        known = self.rows()
        with scratch():
            new = scan(docs, known if complete_folders(self.spark, self.path) else None, self.version)
            new.write.parquet(new_folder(self.path))
        return self.rows()

    def compact(self) -> None:
        """One folder in place of all: many small scans make many folders."""
        old = complete_folders(self.spark, self.path)
        if len(old) > 1:
            self.rows().write.parquet(new_folder(self.path))
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            for folder in old:
                path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """New ledger rows (blob, version, spans) for the texts of ``docs`` that ``ledger`` has not under this rule version.

    Copies of a blob are dropped before the shuffle.  With a ledger, what it lacks is found by digests alone; if that
    is little (FEW digests, 6 MB), they are sent to the texts, else the texts are dealt by digest to them.
    """
    version = version or rule_version()
    blobs = docs.select(F.sha2(whole_text(), 256).alias("blob"), whole_text().alias("text"))
    unseen, few = None, False
    if ledger is not None:
        known = ledger.where(F.col("version") == version).select("blob")
        unseen = stored(blobs.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        few = unseen.count() <= FEW
    if few:
        blobs = blobs.join(F.broadcast(unseen), "blob")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if unseen is not None and not few:
        blobs = blobs.join(unseen.hint("merge"), "blob")
    return blobs.select("blob", F.lit(version).alias("version"), secret_spans(F.col("text")).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, version: str | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns but text) with their blob and spans, from a ledger that has all their blobs.

    Most blobs have no findings: the join is with those that have, and what doesn't meet one has none.
    """
    paths = docs.select(*[c for c in docs.columns if c != "text"], F.sha2(whole_text(), 256).alias("blob"))
    some = ledger.where((F.col("version") == (version or rule_version())) & (F.size("spans") > 0)).select("blob", "spans")
    out = paths.join(some, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def op6_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the ledger already, from earlier runs, isn't scanned again; the rows are the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark).extend(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = listed(F.filter("spans", lambda s: s["kind"] < 3), KINDS)
    out = findings(docs, ledger)
    return out.select("doc_id", count(0), count(1), count(2), sha256(base).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


def _sql() -> str:
    """The same in DuckDB, without the ledger: stretches between matches and matches give the places."""
    quoted = {k: p.replace("'", "''") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, PEM))}
    kinds = " UNION ALL ".join(
        f"SELECT rid, {i} AS kind, '{k}' AS name, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')) AS g, generate_subscripts(string_split_regex(text, '{p}'), 1) AS i FROM d"
        for i, (k, p) in enumerate(quoted.items())
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(KINDS[:3]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS ({kinds}),
s AS (SELECT rid, kind, name, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM u WHERE m IS NOT NULL),
f AS (SELECT *, e - length(m) AS b FROM s WHERE kind <> 0 OR length(regexp_extract(m, '{quoted["assign"]}', 2)) >= {MIN_VALUE}),
j AS (SELECT rid, {counts}, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (rid)"""


ORACLE_SQL = _sql()
