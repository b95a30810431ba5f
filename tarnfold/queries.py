"""The registered queries of the engine, with SQL for each.

Most run on the documents of the ``events`` table (see documents_of_events), whose members are loosely
typed on purpose; the promoted ones run on its typed columns.  The log queries run on versions made of
the ``orders`` table: a customer is a key, an order a version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .edits import set_member
from .functions import canonical_key, document, key_of, member, numeric, textual_score
from .functions.values import allow_repeated_members
from .sources.log import compacted, current_documents, index_scores, latest_versions, live_documents, seconds_left
from .sources.ndjson import documents_of_events, export_ndjson, lines_to_changes
from .streaming import windowed_counts
from .streaming.board import newest_scores

KEYS = ["event:3", "event:77", "nobody", "event:3", "event:500"]
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    allow_repeated_members(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of_events(_read(spark, sf_dir, "events"))


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Events as documents with promoted columns; the VARIANT is there for other paths only."""
    docs = _read(spark, sf_dir, "events")
    docs = docs.select("event_id", "event_type", "user_id", "value", canonical_key(F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("key"), F.try_parse_json("props").alias("v"))
    promoted = {c: (F.col(c), t) for c, t in (("event_type", "string"), ("user_id", "bigint"), ("value", "double"))}
    return docs, promoted


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions: an order puts its customer's document; a fifth of the orders delete by key and a seventh by a filter instead, and some documents have no number."""
    o, n = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    op = F.when(n % 5 == 0, "DEL").when(n % 7 == 0, "DEL_WHERE").otherwise("PUT")
    price = F.when(n % 3 == 0, F.lit('"none"')).otherwise(F.floor("o_totalprice").cast("string"))
    raw = F.when(op == "PUT", F.concat(F.lit('{"price":'), price, F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"}')))
    key = canonical_key(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    return o.select(key.alias("key"), raw.alias("raw"), n.alias("seq"), F.lit(0).alias("batch_pos"), F.col("o_orderdate").alias("ts"), op.alias("op"))


def board_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scored(_docs(spark, sf_dir), "value")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scored(_docs(spark, sf_dir), "props.k")


def _uuid(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("uuid"), "raw")


#: DuckDB: the key of a text, the events as typed members, and the versions.
def _sql_key(text: str) -> str:
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({text}))"
    byte = f"((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) * 16 + instr('0123456789abcdef', substr({h}, 18, 1)) - 1)"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), printf('%02x', ({byte} & 63) | 128) || substr({h}, 19, 2), substr({h}, 21, 12))"


_N = "printf('%.2f', value)"
EVENTS = f"""e AS (SELECT {_sql_key("'event:' || event_id")} AS key, event_id, event_type, user_id, props, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 13 = 0 THEN 'string' ELSE 'number' END AS kind, CAST({_N} AS DOUBLE) AS x,
  '{{"event_type":"' || event_type || '","user_id":' || user_id || ',"props":' || props || ',"tags":["t' || (event_id % 5) || '","' || event_type || '"]'
  || CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN ',"value":null' WHEN event_id % 13 = 0 THEN ',"value":"' || {_N} || '"' ELSE ',"value":' || {_N} END || '}}' AS raw
  FROM events)"""
VERSIONS = f"""l AS (SELECT {_sql_key("'customer:' || o_custkey")} AS key, o_orderkey AS seq,
  CASE WHEN o_orderkey % 5 = 0 THEN 'DEL' WHEN o_orderkey % 7 = 0 THEN 'DEL_WHERE' ELSE 'PUT' END AS op,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN '{{"price":' || CASE WHEN o_orderkey % 3 = 0 THEN '"none"' ELSE CAST(floor(o_totalprice) AS BIGINT)::VARCHAR END || ',"status":"' || o_orderstatus || '"}}' END AS raw,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN floor(o_totalprice) END AS price, o_orderstatus AS status FROM orders)"""
NEWEST = VERSIONS + ", n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
BOARD = EVENTS + ", b AS (SELECT key, x AS score FROM e WHERE kind = 'number'), r AS (SELECT row_number() OVER (ORDER BY score DESC, key DESC) AS rank, key AS uuid, score FROM b)"
TIES = EVENTS + ", b AS (SELECT key, k AS score FROM e), r AS (SELECT row_number() OVER (ORDER BY score DESC, key DESC) AS rank, key AS uuid, score FROM b)"


def _filtered(query: str) -> Query:
    return lambda spark, d: _uuid(ops.matching(_docs(spark, d), query))


#: name: (filter, the same in SQL over the members of EVENTS)
FILTERS = {
    "filter_eq": ('event_type = "click"', "event_type = 'click'"),
    "filter_eq_number": ("props.k == 42", "abs(k - 42) < 1e-9"),
    "filter_eq_type": ("user_id = '5'", "false"),
    "filter_ne_missing": ("value != 12.34", "NOT (kind = 'number' AND abs(x - 12.34) < 1e-9)"),
    "filter_ne_null": ("value != null", "kind <> 'null'"),
    "filter_gt": ("value > 100", "kind = 'number' AND x > 100"),
    "filter_gte": ("value >= 100.5", "kind = 'number' AND x >= 100.5"),
    "filter_lt": ("value < 20", "kind = 'number' AND x < 20"),
    "filter_lte": ("props.k <= 3", "k <= 3"),
    "filter_null": ("value = null", "kind = 'null'"),
    "filter_missing_null": ("nothing = null", "false"),
    "filter_contains_str": ('event_type CONTAINS "ic"', "event_type LIKE '%ic%'"),
    "filter_contains_arr": ('tags CONTAINS "t3"', "event_id % 5 = 3"),
    "filter_and_or": ("value > 200 AND props.k < 50 OR event_type = 'view' AND user_id <= 20", "(kind = 'number' AND x > 200 AND k < 50) OR (event_type = 'view' AND user_id <= 20)"),
    "filter_quoted_words": ("event_type = 'a AND b' OR props.k = 7", "abs(k - 7) < 1e-9"),
}


def _json_set(spark: SparkSession, d: str) -> DataFrame:
    """A member of every document set by one Arrow-batched function; the path and the value are arbitrary."""
    put = F.pandas_udf(lambda raw: raw.map(lambda r: set_member(r, "props.level", 7)), "string")
    return _docs(spark, d).select(F.col("key").alias("uuid"), put("raw").alias("raw"))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Exported lines read again: keys and numbers stay."""
    back = lines_to_changes(export_ndjson(_docs(spark, d)))
    return back.select("key", document(F.col("raw")).alias("v")).select("key", member(F.col("v"), "user_id").number.cast("long").alias("user_id"), numeric(F.col("v"), "value").alias("value"))


def _with_ttl(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Column]:
    """Documents, TTLs and a clock: keys expire at their customer's first order plus 400 days; later puts don't help."""
    log = _log(spark, d)
    ttl = log.groupBy("key").agg((F.min("ts") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.lit(1).cast("long").alias("seq"))
    return current_documents(log), ttl, F.lit("1996-06-01 00:00:00").cast("timestamp")


def _ttl_live(spark: SparkSession, d: str) -> DataFrame:
    return live_documents(*_with_ttl(spark, d)).select("key", "raw")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are objects, strings, other values and no JSON, by the event's id."""
    n = F.col("event_id")
    own = lambda before, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    kinds = [
        own('"  Bob ', ' "'), F.lit('"  "'), own(" plain text ", "  "), own('{"name":"\\t","title":"T', '"}'), n.cast("string"),
        own("x" * 70, ""), own('{"id":"x","user":"U', '","name":7}'), F.lit('["name"]'),
    ]
    raw = F.get(F.array(*kinds), (n % len(kinds)).cast("int"))
    docs = _read(spark, d, "events").select(canonical_key(own("event:", "")).alias("key"), raw.alias("raw"))
    return docs.withColumn("v", document(F.col("raw")))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """Every second document has something behind its end, which is no JSON."""
    docs = _docs(spark, d)
    even = F.substring("key", 1, 1).isin(*"02468ace")
    docs = docs.withColumn("raw", F.when(even, F.concat("raw", F.lit(" x"))).otherwise(F.col("raw")))
    return docs.withColumn("v", document(F.col("raw")))


def _delete_where(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a delete by filter is appended to the log."""
    log = _log(spark, d)
    gone = ops.matching(current_documents(log), "price >= 200000").select("key", F.lit(None).cast("string").alias("raw"), F.lit(10**12).alias("seq"), F.lit(0).alias("batch_pos"), F.lit(None).cast("timestamp").alias("ts"), F.lit("DEL_WHERE").alias("op"))
    return current_documents(log.unionByName(gone)).select("key", "raw")


def _txn_batch(spark: SparkSession, d: str) -> DataFrame:
    """One batch of several rows a key: the last place counts."""
    log = _log(spark, d)
    keys = log.select("key").distinct()
    rows = [F.struct(F.lit(raw).cast("string").alias("raw"), F.lit(i).alias("batch_pos"), F.lit(op).alias("op")) for i, (raw, op) in enumerate((('{"price":1}', "PUT"), (None, "DEL"), ('{"price":2}', "PUT")))]
    batch = keys.select("key", F.explode(F.array(*rows)).alias("r")).select("key", "r.raw", F.lit(10**12).alias("seq"), "r.batch_pos", F.lit(None).cast("timestamp").alias("ts"), "r.op")
    return current_documents(log.unionByName(batch)).select("key", "raw")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return ops.physical_stats(log).drop("value_bytes")


QUERIES: dict[str, Query] = {
    "uuid_v5_key": lambda s, d: _read(s, d, "customer").select("c_custkey", canonical_key(F.col("c_name")).alias("key")),
    "point_get": lambda s, d: _uuid(ops.point_get(_docs(s, d), "event:77")),
    "multi_get": lambda s, d: ops.multi_get(_docs(s, d), KEYS),
    "exists_count": lambda s, d: ops.exists_count(_docs(s, d), KEYS),
    "range_scan": lambda s, d: _uuid(ops.range_scan(_docs(s, d), "event:1", None, 50)),
    "range_scan_both": lambda s, d: _uuid(ops.range_scan(_docs(s, d), "40000000-0000-0000-0000-000000000000", "50000000-0000-0000-0000-000000000000", 10_000)),
    "key_labels": lambda s, d: ops.key_labels(_docs(s, d).withColumn("v", F.try_parse_json(F.concat(F.lit('{"name":"  ","title":"T'), F.substring("key", 1, 4), F.lit('"}')))), 50_000),
    "label_lookup": lambda s, d: _uuid(ops.find_by_label(_read(s, d, "customer").select(canonical_key(F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit('{"name":" '), F.col("c_name"), F.lit(' "}')).alias("raw")).withColumn("v", F.try_parse_json("raw")), "customer#000000042", None)),
    "key_labels_mixed": lambda s, d: ops.key_labels(_mixed(s, d), 50_000),
    "shown_mixed": lambda s, d: ops.lookup.shown(_mixed(s, d)).select("uuid", F.to_json("data").alias("data")),
    "top_none": lambda s, d: ops.top_n(board_of_events(s, d), 0),
    "sorted_by_members": lambda s, d: _docs(s, d).select("key", member(F.col("v"), "props.k").number.alias("k"), member(F.col("v"), "event_type").string.alias("kind")).orderBy(F.desc("kind"), "k", "key").limit(300),
    "web_scan": lambda s, d: _uuid(ops.web_scan(_docs(s, d), " ", "f0000000-0000-0000-0000-000000000000", "no number")),
    "web_filter_compat": lambda s, d: _uuid(ops.web_filter(_docs(s, d), "props.k >= 50", "5000", compat=True)),
    "filter_broken_json": lambda s, d: _uuid(ops.matching(_broken(s, d), "value != 12.34")),
    "count_broken_json": lambda s, d: ops.count_documents(_broken(s, d)),
    **{name: _filtered(query) for name, (query, _) in FILTERS.items()},
    "filter_promoted": lambda s, d: (lambda docs, p: ops.matching(docs, 'value > 100 AND event_type = "click" OR user_id = 3', p).select("event_id", "value"))(*_typed(s, d)),
    "filter_capped_compat": lambda s, d: _uuid(ops.filter_documents(_docs(s, d), "props.k >= 90", 10_000, compat=True)),
    "filter_first": lambda s, d: _uuid(ops.filter_documents(_docs(s, d), "props.k >= 90")),
    "count_all": lambda s, d: ops.count_documents(_docs(s, d)),
    "count_where": lambda s, d: ops.count_documents(_docs(s, d), "value > 100 AND props.k < 50"),
    "count_promoted": lambda s, d: (lambda docs, p: ops.count_documents(docs, "value > 100 AND user_id <= 50", p))(*_typed(s, d)),
    "calc_stats": lambda s, d: ops.calc_stats(_docs(s, d), "props.k"),
    "calc_stats_where": lambda s, d: ops.calc_stats(_docs(s, d), "props.k", 'event_type = "click"'),
    "calc_stats_empty": lambda s, d: ops.calc_stats(_docs(s, d), "nothing"),
    "calc_stats_numeric_string": lambda s, d: (lambda r: r.select("field", "count", "min", "max"))(ops.calc_stats(_docs(s, d), "value")),
    "top_n": lambda s, d: ops.top_n(board_of_events(s, d), 25),
    "top_n_ties": lambda s, d: ops.top_n(_ties(s, d), 1000),
    "rank_of_key": lambda s, d: ops.rank_of_key(board_of_events(s, d), "event:3"),
    "rank_of_key_ties": lambda s, d: ops.rank_of_key(_ties(s, d), "event:77"),
    "rank_of_unscored": lambda s, d: ops.rank_of_key(board_of_events(s, d), "event:7"),
    "around_key": lambda s, d: ops.around_key(_ties(s, d), "event:77", 15),
    "around_score": lambda s, d: ops.around_score(board_of_events(s, d), 100.0, 11),
    "around_score_end": lambda s, d: ops.around_score(board_of_events(s, d), -1.0, 7),
    "score_range": lambda s, d: ops.score_range(board_of_events(s, d), 50.0, 60.0, 1000),
    "rank_range": lambda s, d: ops.rank_range(_ties(s, d), 30, 250),
    "rank_range_deep": lambda s, d: ops.rank_range(_ties(s, d), 900, 1100, near=50),
    "rankings_around_score": lambda s, d: ops.rankings(board_of_events(s, d), "around_score", 1200, score=250.0),
    "rankings_score_range": lambda s, d: ops.rankings(board_of_events(s, d), "score_range", 2000, low=20.0, high=300.0),
    "rankings_rank_range": lambda s, d: ops.rankings(board_of_events(s, d), "rank_range", first=5, last=60),
    "textual_scores": lambda s, d: _docs(s, d).select("key", textual_score(F.col("raw"), "value").alias("score")).where("score IS NOT NULL"),
    "textual_scores_nested": lambda s, d: _docs(s, d).select("key", textual_score(F.col("raw"), "props.k").alias("score")).where("score IS NOT NULL"),
    "rankings_uncapped": lambda s, d: ops.rankings(_ties(s, d), "top", 1500),
    "rankings_around": lambda s, d: ops.rankings(_ties(s, d), "around_key", 20, key="event:77"),
    "search": lambda s, d: ops.search(_docs(s, d), "CLICK").select("uuid", "label"),
    "percentiles": lambda s, d: ops.percentiles(_read(s, d, "events"), "value"),
    "byte_sizes": lambda s, d: _read(s, d, "customer").select("c_custkey", ops.byte_size(F.pow(F.lit(9), F.col("c_custkey") % 11).cast("long")).alias("size")),
    "latest_version": lambda s, d: latest_versions(_log(s, d)),
    "current_documents": lambda s, d: current_documents(_log(s, d)).select("key", "raw", "seq"),
    "delete_where": _delete_where,
    "ttl_live": _ttl_live,
    "ttl_get": lambda s, d: seconds_left(*_with_ttl(s, d)),
    "compacted_log": lambda s, d: compacted(_log(s, d))[0].select("key", "raw", "seq", "op"),
    "compacted_gone": lambda s, d: compacted(_log(s, d))[1].select("key", "seq", "op"),
    "log_audit": lambda s, d: ops.log_audit(_log(s, d)),
    "txn_batch": _txn_batch,
    "index_history": lambda s, d: index_scores(_log(s, d), "price", 1000),
    "board_of_log": lambda s, d: newest_scores(_log(s, d), "price").where("score is not null").select("key", "score"),
    "log_stats": _audit,
    "json_set": _json_set,
    "ndjson_round_trip": _round_trip,
    "windowed_counts": lambda s, d: windowed_counts(_read(s, d, "events"), "ts", "6 hours", "1 day", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")),
}


def _stats(x: str, where: str, field: str) -> str:
    return f"SELECT '{field}' AS field, count({x}) AS count, coalesce(sum({x}), 0.0) AS sum, coalesce(avg({x}), 0.0) AS avg, coalesce(min({x}), 0.0) AS min, coalesce(max({x}), 0.0) AS max FROM e WHERE {where}"


def _listed(keys: list[str]) -> str:
    return ", ".join(f"({i}, '{key_of(k)}')" for i, k in enumerate(keys))


def _around_sql(rank: str, limit: int) -> str:
    return f"SELECT rank, uuid, score FROM (SELECT *, {rank} AS c, count(*) OVER () AS n FROM r) WHERE rank BETWEEN least(greatest(1, c - {limit // 2}), greatest(1, n - {limit} + 1)) AND least(greatest(1, c - {limit // 2}), greatest(1, n - {limit} + 1)) + {limit - 1}"


_E = f"WITH {EVENTS} "
ORACLE_SQL: dict[str, str] = {
    "uuid_v5_key": f"SELECT c_custkey, {_sql_key('c_name')} AS key FROM customer",
    "point_get": _E + f"SELECT key AS uuid, raw FROM e WHERE key = '{key_of('event:77')}'",
    "multi_get": _E + f"SELECT pos, a.key, raw FROM (VALUES {_listed(KEYS)}) a(pos, key) LEFT JOIN e ON a.key = e.key",
    "exists_count": _E + f"SELECT count(*) AS n FROM (VALUES {_listed(KEYS)}) a(pos, key) WHERE key IN (SELECT key FROM e)",
    "range_scan": _E + f"SELECT key AS uuid, raw FROM e WHERE key >= '{key_of('event:1')}' ORDER BY key LIMIT 50",
    "range_scan_both": _E + "SELECT key AS uuid, raw FROM e WHERE key BETWEEN '40000000-0000-0000-0000-000000000000' AND '50000000-0000-0000-0000-000000000000' ORDER BY key LIMIT 10000",
    "key_labels": _E + "SELECT key AS uuid, 'T' || substr(key, 1, 4) AS label FROM e ORDER BY key LIMIT 50000",
    "label_lookup": f"SELECT {_sql_key('CAST(c_custkey AS VARCHAR)')} AS uuid, '{{\"name\":\" ' || c_name || ' \"}}' AS raw FROM customer WHERE lower(trim(c_name)) = 'customer#000000042' ORDER BY 1 LIMIT 1",
    "key_labels_mixed": _E + """SELECT key AS uuid, CASE event_id % 8 WHEN 0 THEN 'Bob ' || event_id WHEN 2 THEN 'plain text ' || event_id WHEN 3 THEN 'T' || event_id WHEN 6 THEN 'U' || event_id ELSE key END AS label
  FROM e ORDER BY key LIMIT 50000""",
    "shown_mixed": _E + """SELECT key AS uuid, CASE event_id % 8 WHEN 0 THEN '"  Bob ' || event_id || ' "' WHEN 1 THEN '"  "' WHEN 2 THEN '" plain text ' || event_id || '  "' WHEN 3 THEN '{"name":"\\t","title":"T' || event_id || '"}'
  WHEN 4 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN '"' || repeat('x', 70) || event_id || '"' WHEN 6 THEN '{"id":"x","name":7,"user":"U' || event_id || '"}' ELSE '["name"]' END AS data FROM e""",
    "top_none": f"WITH {BOARD} SELECT * FROM r WHERE false",
    "sorted_by_members": _E + "SELECT key, k, event_type AS kind FROM e ORDER BY kind DESC, k, key LIMIT 300",
    "web_scan": _E + "SELECT key AS uuid, raw FROM e WHERE key <= 'f0000000-0000-0000-0000-000000000000' ORDER BY key LIMIT 100",
    "web_filter_compat": _E + "SELECT key AS uuid, raw FROM (SELECT * FROM e ORDER BY key LIMIT 10000) WHERE k >= 50 ORDER BY key LIMIT 1000",
    "filter_broken_json": _E + "SELECT key AS uuid, raw FROM e WHERE substr(key, 1, 1) NOT IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AND NOT (kind = 'number' AND abs(x - 12.34) < 1e-9)",
    "count_broken_json": "SELECT count(*) AS n FROM events",
    **{name: _E + f"SELECT key AS uuid, raw FROM e WHERE {where}" for name, (_, where) in FILTERS.items()},
    "filter_promoted": "SELECT event_id, value FROM events WHERE (value > 100 AND event_type = 'click') OR user_id = 3",
    "filter_capped_compat": _E + "SELECT key AS uuid, raw FROM (SELECT * FROM e ORDER BY key LIMIT 100000) WHERE k >= 90 ORDER BY key LIMIT 10000",
    "filter_first": _E + "SELECT key AS uuid, raw FROM e WHERE k >= 90 ORDER BY key LIMIT 100",
    "count_all": "SELECT count(*) AS n FROM events",
    "count_where": _E + "SELECT count(*) AS n FROM e WHERE kind = 'number' AND x > 100 AND k < 50",
    "count_promoted": "SELECT count(*) AS n FROM events WHERE value > 100 AND user_id <= 50",
    "calc_stats": _E + _stats("k", "true", "props.k"),
    "calc_stats_where": _E + _stats("k", "event_type = 'click'", "props.k"),
    "calc_stats_empty": "SELECT 'nothing' AS field, 0::BIGINT AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS min, 0.0::DOUBLE AS max",
    "calc_stats_numeric_string": _E + "SELECT 'value' AS field, count(*) AS count, min(x) AS min, max(x) AS max FROM e WHERE kind IN ('number', 'string')",
    "top_n": f"WITH {BOARD} SELECT * FROM r WHERE rank <= 25",
    "top_n_ties": f"WITH {TIES} SELECT * FROM r WHERE rank <= 1000",
    "rank_of_key": f"WITH {BOARD} SELECT rank, uuid, score, n AS total_ranked FROM (SELECT *, count(*) OVER () AS n FROM r) WHERE uuid = '{key_of('event:3')}'",
    "rank_of_key_ties": f"WITH {TIES} SELECT rank, uuid, score, n AS total_ranked FROM (SELECT *, count(*) OVER () AS n FROM r) WHERE uuid = '{key_of('event:77')}'",
    "rank_of_unscored": f"WITH {BOARD} SELECT rank, uuid, score, 0::BIGINT AS total_ranked FROM r WHERE uuid = '{key_of('event:7')}'",
    "around_key": f"WITH {TIES} " + _around_sql(f"(SELECT rank FROM r WHERE uuid = '{key_of('event:77')}')", 15),
    "around_score": f"WITH {BOARD} " + _around_sql("(SELECT least(count(*), 1 + count(*) FILTER (WHERE score > 100.0)) FROM r)", 11),
    "around_score_end": f"WITH {BOARD} " + _around_sql("(SELECT least(count(*), 1 + count(*) FILTER (WHERE score > -1.0)) FROM r)", 7),
    "score_range": f"WITH {BOARD} SELECT * FROM r WHERE score BETWEEN 50.0 AND 60.0 ORDER BY rank LIMIT 1000",
    "rank_range": f"WITH {TIES} SELECT * FROM r WHERE rank BETWEEN 30 AND 250",
    "rank_range_deep": lambda s, d: ops.rank_range(_ties(s, d), 900, 1100, near=50),
    "rankings_around_score": lambda s, d: ops.rankings(board_of_events(s, d), "around_score", 1200, score=250.0),
    "rankings_score_range": lambda s, d: ops.rankings(board_of_events(s, d), "score_range", 2000, low=20.0, high=300.0),
    "rankings_rank_range": lambda s, d: ops.rankings(board_of_events(s, d), "rank_range", first=5, last=60),
    "textual_scores": lambda s, d: _docs(s, d).select("key", textual_score(F.col("raw"), "value").alias("score")).where("score IS NOT NULL"),
    "textual_scores_nested": lambda s, d: _docs(s, d).select("key", textual_score(F.col("raw"), "props.k").alias("score")).where("score IS NOT NULL"),
    "rank_range_deep": f"WITH {TIES} SELECT * FROM r WHERE rank BETWEEN 900 AND 1100",
    "rankings_around_score": f"WITH {BOARD} " + _around_sql("(SELECT least(count(*), 1 + count(*) FILTER (WHERE score > 250.0)) FROM r)", 1200),
    "rankings_score_range": f"WITH {BOARD} SELECT * FROM r WHERE score BETWEEN 20.0 AND 300.0 ORDER BY rank LIMIT 2000",
    "rankings_rank_range": f"WITH {BOARD} SELECT * FROM r WHERE rank BETWEEN 5 AND 60",
    "textual_scores": _E + "SELECT key, x AS score FROM e WHERE kind = 'number'",
    "textual_scores_nested": _E + "SELECT key, k AS score FROM e",
    "rankings_uncapped": f"WITH {TIES} SELECT * FROM r WHERE rank <= 1500",
    "rankings_around": f"WITH {TIES} " + _around_sql(f"(SELECT rank FROM r WHERE uuid = '{key_of('event:77')}')", 20),
    "search": _E + "SELECT key AS uuid, key AS label FROM e WHERE raw LIKE '%click%'",
    "percentiles": "WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT avg(value) AS avg, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.9)) AS p90, max(value) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM o",
    "byte_sizes": "SELECT c_custkey, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE b || ' B' END AS size FROM (SELECT c_custkey, CAST(pow(9, c_custkey % 11) AS BIGINT) AS b FROM customer)",
    "latest_version": f"WITH {NEWEST} SELECT key, raw, seq, op FROM n",
    "current_documents": f"WITH {NEWEST} SELECT key, raw, seq FROM n WHERE op = 'PUT'",
    "delete_where": f"WITH {NEWEST} SELECT key, raw FROM n WHERE op = 'PUT' AND NOT coalesce(price >= 200000, false)",
    "ttl_live": f"WITH {NEWEST}, t AS (SELECT {_sql_key("'customer:' || o_custkey")} AS key, min(o_orderdate) + INTERVAL 400 DAYS AS expires_at FROM orders GROUP BY 1) SELECT n.key, raw FROM n JOIN t ON n.key = t.key WHERE op = 'PUT' AND expires_at > TIMESTAMP '1996-06-01 00:00:00'",
    "ttl_get": f"WITH {NEWEST}, t AS (SELECT {_sql_key("'customer:' || o_custkey")} AS key, min(o_orderdate) + INTERVAL 400 DAYS AS expires_at FROM orders GROUP BY 1) SELECT n.key, CAST(epoch(CAST(expires_at AS TIMESTAMP)) - epoch(TIMESTAMP '1996-06-01 00:00:00') AS BIGINT) AS left FROM n JOIN t ON n.key = t.key WHERE op = 'PUT' AND expires_at > TIMESTAMP '1996-06-01 00:00:00'",
    "compacted_log": f"WITH {NEWEST} SELECT key, raw, seq, op FROM n WHERE op = 'PUT'",
    "compacted_gone": f"WITH {NEWEST} SELECT key, seq, op FROM n WHERE op <> 'PUT'",
    "log_audit": f"WITH {VERSIONS} SELECT count(*) AS rows, count(DISTINCT key) AS keys, 0::BIGINT AS invalid_json, 0::BIGINT AS doubled FROM l",
    "txn_batch": f"WITH {VERSIONS} SELECT DISTINCT key, '{{\"price\":2}}' AS raw FROM l",
    "index_history": f"WITH {VERSIONS}, p AS (SELECT key, max(seq) FILTER (WHERE op = 'DEL') AS gone, max(seq) FILTER (WHERE price IS NOT NULL AND seq > 1000) AS put FROM l GROUP BY key) SELECT p.key, l.price AS score FROM p JOIN l ON l.key = p.key AND l.seq = p.put WHERE put > coalesce(gone, 0)",
    "board_of_log": f"WITH {NEWEST} SELECT key, price AS score FROM n WHERE price IS NOT NULL",
    "log_stats": f"WITH {VERSIONS} SELECT count(*) AS total_records, count(*) FILTER (WHERE op <> 'PUT') AS tombstones, count(DISTINCT key) AS keys, max(seq) AS last_seq FROM l",
    "json_set": _E + f"""SELECT key AS uuid, '{{"event_type":"' || event_type || '","props":{{"k":' || CAST(k AS BIGINT) || ',"level":7}},"tags":["t' || (event_id % 5) || '","' || event_type || '"],"user_id":' || user_id
  || CASE WHEN kind = 'missing' THEN '' WHEN kind = 'null' THEN ',"value":null' WHEN kind = 'string' THEN ',"value":"' || printf('%.2f', x) || '"' ELSE ',"value":' || (CASE WHEN x = floor(x) THEN printf('%.1f', x) WHEN x * 10 = floor(x * 10) THEN printf('%.1f', x) ELSE printf('%.2f', x) END) END || '}}' AS raw FROM e""",
    "ndjson_round_trip": _E + "SELECT key, user_id, CASE WHEN kind IN ('number', 'string') THEN x END AS value FROM e",
    "windowed_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
