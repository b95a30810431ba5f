"""Quality rules with verdicts per host.

A host (the ``source`` column) has a failure rate: the share of its documents that break a rule.  Rates
are shrunk towards all hosts' by a beta prior fitted to them by moments, so that a small host is not
judged by a few documents.  A host whose shrunk rate is in the prior's upper tail (more than TAIL standard deviations
above its mean), or reaches ``bad_rate``, is strict ground: its documents are held to the strict limits, others to the usual
ones.  A document that breaks no limit stays wherever it comes from.

Defined results: a null text has no words, and fails the base rule; a null source is a host of its own; a very long
text is read as a whole; repeated rows and ties of doc_id are judged each; hosts that tie get the same verdict; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored, table, whole_text
from .words import batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shrunk failure rate from which a host is strict ground whatever the others' are, and how far in the prior's tail it is so otherwise (a host in a hundred, were they as a normal distribution).
BAD_RATE, TAIL = 0.5, 2.33
#: (usual, strict) limits: symbols a word, share of capitals among ASCII letters, share of repeated lines, characters a word.
LIMITS = {"symbols": (0.2, 0.1), "capitals": (0.6, 0.4), "repeated_lines": (0.5, 0.35), "long_words": (15.0, 12.0)}
FIGURES = {
    "symbols": "n_symbols / greatest(n_words, 1)", "capitals": "n_upper / greatest(n_letters, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)", "long_words": "word_chars / greatest(n_words, 1)",
}
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"
_NAMES = [x.split()[0] for x in STATS.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    number = dict.fromkeys(words)
    for i, w in enumerate(number):
        number[w] = i
    k = len(number)
    if k == n:
        return 0
    c = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = c[:-1] * k + c[1:]
    if k >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        k = max(k, int(pair.max()) + 1)
    triple = pair[:-1] * k + c[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    within = np.zeros(n, bool)
    for d in range(3):
        within[d : n - 2 + d] |= again
    return int(within.sum())


def text_stats(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(letters[65:91].sum()), int(letters[97:123].sum())
    blank = int(letters[9:14].sum() + letters[32])
    symbols = int(letters[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, upper + lower


def with_stats(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Replaces ``text`` by the columns of STATS; all other columns go along.

    ``row`` names a struct column that has the text instead, and stays as it is.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType(kept + T.StructType.fromDDL(STATS).fields)

    def text(batch):
        return batch.column(row).field("text") if row else batch.column("text")

    def count(rows):
        import pyarrow as pa

        for batch in batches(rows, text):
            found = [text_stats(t or "") for t in text(batch).to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + _NAMES)

    return docs.mapInArrow(count, schema)


def base_failed() -> Column:
    return F.expr(BASE_FAILED)


def broken(strict: bool) -> str:
    """SQL that tells whether a document breaks a limit."""
    return "(" + " OR ".join(f"{FIGURES[name]} > {limits[strict]}" for name, limits in LIMITS.items()) + ")"


def verdict(bad_rate: float) -> Column:
    """Whether a document is kept, by its figures and its host's rate."""
    limit = F.when((F.col("host_rate") >= bad_rate) | (F.col("host_rate") > F.col("host_limit")), F.expr(broken(True))).otherwise(F.expr(broken(False)))
    return ~(base_failed() | limit)


def host_rates(stats: DataFrame) -> DataFrame:
    """(source, host_docs, host_rate, host_limit): failure rates shrunk by a beta prior of mean m and strength s, and where the prior's tail begins.

    With the variance v of the rates over hosts, less what sampling explains, s = m (1 - m) / v - 1, held to 1..1000.
    """
    failed = (base_failed() | F.expr(broken(False))).cast("double")
    hosts = stats.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(failed).alias("failures"))
    rate = F.col("failures") / F.col("host_docs")
    m, spread, per_host = hosts.agg(F.sum("failures") / F.sum("host_docs"), F.var_pop(rate), F.avg(1 / F.col("host_docs"))).first()
    m = m or 0.0
    v = max((spread or 0.0) - m * (1 - m) * (per_host or 0.0), 1e-9)
    s = max(1.0, min(1000.0, m * (1 - m) / v - 1))
    tail = m + TAIL * (m * (1 - m) / (s + 1)) ** 0.5
    return hosts.select("source", "host_docs", F.lit(float(tail)).alias("host_limit"), ((F.col("failures") + F.lit(m * s)) / (F.col("host_docs") + F.lit(s))).alias("host_rate"))


def judged(stats: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """Adds host_docs, host_rate, base_failed and kept; ``stats`` is read twice, so it should be a stored table."""
    hosts = host_rates(stats).withColumnRenamed("source", "_source")
    out = stats.join(hosts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", verdict(bad_rate))


def kept(docs: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """The rows of ``docs`` (source, text and others) that the rules keep.

    Figures are made twice, for the hosts' rates and for the verdicts, so that texts are neither stored nor
    shuffled: the table of hosts is stored, so that Spark knows its size and broadcasts it if it is small.
    """
    with scratch() as keep:
        hosts = host_rates(stored(with_stats(docs.select("source", whole_text().alias("text"))), "stats"))
        hosts = keep(stored(hosts, "hosts"))
    hosts = hosts.withColumnRenamed("source", "_source")
    rows = with_stats(docs.select(F.struct(*docs.columns).alias("doc"), "source"), "doc")
    rows = rows.join(hosts, F.col("source").eqNullSafe(F.col("_source")))
    return rows.where(verdict(bad_rate)).select("doc.*")


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", whole_text().alias("text"))
    out = judged(stored(with_stats(docs), "stats"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB, with the limits written out: windows by position, and the host verdicts from the rows' figures.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
q AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols, n_upper / greatest(n_letters, 1) AS capitals, n_dup_lines / greatest(n_lines, 1) AS lines, word_chars / greatest(n_words, 1) AS long FROM s),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  symbols > 0.2 OR capitals > 0.6 OR lines > 0.5 OR long > 15 AS usual, symbols > 0.1 OR capitals > 0.4 OR lines > 0.35 OR long > 12 AS strict FROM q),
h AS (SELECT source, count(*) AS k, sum(CASE WHEN base_failed OR usual THEN 1 ELSE 0 END) AS x FROM f GROUP BY source),
m AS (SELECT sum(x) / sum(k) AS m, var_pop(x / k) - sum(x) / sum(k) * (1 - sum(x) / sum(k)) * avg(1 / k) AS v FROM h),
p AS (SELECT m, greatest(1.0, least(1000.0, m * (1 - m) / greatest(v, 1e-9) - 1)) AS s FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR CASE WHEN (x + m * p.s) / (k + p.s) >= 0.5 OR (x + m * p.s) / (k + p.s) > m + 2.33 * sqrt(m * (1 - m) / (p.s + 1)) THEN strict ELSE usual END) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN p"""
