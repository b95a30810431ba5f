import json

import pytest
from pyspark.sql import functions as F

from tarnfold.edits import literal_value, set_member
from tarnfold.functions import key_of
from tarnfold.plans import CommandError, parse_command
from tarnfold.sources import index_scores
from tarnfold.streaming import BoardStream, read_log
from tarnfold.table import Session, Table

PLAYERS = [("herobrine", 9999, 120000), ("alex", 2100, 900), ("steve", 1421, 50000), ("notch", 500, None)]


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


def ranks(df):
    return [(r["rank"], r["uuid"]) for r in df.collect()]


def fill(session):
    lines = " ".join(f"{k} {json.dumps({'name': k, 'stats': {'kills': n} | ({'coins': c} if c else {})})}" for k, n, c in PLAYERS)
    assert session.run(f"MSET Players {lines}") == "OK"


def test_tutorial(session):
    fill(session)
    k = {n: key_of(n) for n, *_ in PLAYERS}
    assert session.run("TABLES") == ["players"]
    assert ranks(session.run("TOP players stats.kills 3")) == [(1, k["herobrine"]), (2, k["alex"]), (3, k["steve"])]
    assert session.run("RANK players stats.kills steve").first().asDict() == {"rank": 3, "uuid": k["steve"], "score": 1421.0, "total_ranked": 4}
    assert ranks(session.run("RANK.KEY players stats.kills steve 3")) == [(2, k["alex"]), (3, k["steve"]), (4, k["notch"])]
    assert ranks(session.run("AROUND players stats.kills 2000 2")) == [(2, k["alex"]), (3, k["steve"])]
    assert ranks(session.run("RANK.RANGE_SCORE players stats.kills 1000 3000")) == [(2, k["alex"]), (3, k["steve"])]
    found = session.run('FILTER players "stats.kills > 1000 AND stats.coins >= 50000 AND stats.kills < 9000"').collect()
    assert [r.uuid for r in found] == [k["steve"]]
    assert session.run('COUNT players "stats.kills > 1000"').first().n == 3
    assert session.run("STATS players stats.kills").first().asDict() == {"field": "stats.kills", "count": 4, "sum": 14020.0, "avg": 3505.0, "min": 500.0, "max": 9999.0}


def test_changes(session):
    fill(session)
    session.run("JSON.SET players notch stats.kills 5000")
    session.run("JSON.SET players newcomer a.b 'x'")
    assert [r[1] for r in ranks(session.run("TOP players stats.kills 2"))] == [key_of("herobrine"), key_of("notch")]
    assert session.run("GET players newcomer").select(F.to_json("data")).first()[0] == '{"a":{"b":"x"}}'
    assert session.run("DEL players herobrine") == 1 and session.run("DEL players nobody") == 1
    assert session.run("DEL_WHERE players stats.kills < 2000") == 1
    assert session.run("EXISTS players alex alex steve").first().n == 2
    assert [r.raw is None for r in session.run("MGET players steve alex steve").collect()] == [True, False, True]
    table = session.table("players")
    before = sorted(map(str, table.documents().select("key", "raw").collect()))
    table.log.compact()
    assert sorted(map(str, table.documents().select("key", "raw").collect())) == before
    assert table.log.rows().count() == 3 and table.audit().first().asDict() == {"rows": 3, "keys": 3, "invalid_json": 0, "doubled": 0}


def test_transactions(session):
    session.run("CREATE TABLE t")
    session.run("MULTI")
    assert session.run('SET t a {"x": 1}') == "QUEUED"
    for line in ('SET t a {"x": 2}', "COUNT t", "DEL t a", 'SET t b "plain words"'):
        session.run(line)
    out = session.run("EXEC")
    assert out[0] == out[1] == "OK" and out[2].first().n == 1 and out[3:] == [1, "OK"]
    assert [r.key for r in session.table("t").documents().collect()] == [key_of("b")]
    with pytest.raises(CommandError):
        session.run("EXEC")
    with pytest.raises(CommandError):
        session.run("GET nowhere k")


def test_ttl(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    t = Table(spark, str(tmp_path / "t"), now=at("2024-01-01 00:00:00"))
    t.set("a", "{}")
    assert t.expire("nobody", 5) == 0 and t.ttl("nobody") == -2 and t.ttl("a") == -1
    assert t.expire("a", 60) == 1 and t.ttl("a") == 60
    t.now = at("2024-01-01 00:01:00")
    assert t.get("a").count() == 0 and t.ttl("a") == -2
    t.set("a", '{"again":1}')  # a TTL belongs to the key
    assert t.count().first().n == 0


def test_load_dump_backup_truncate_drop(session, tmp_path):
    lines = tmp_path / "in.ndjson"
    lines.write_text('{"uuid":"a","data":{"x":1}}\nbroken\n{"uuid":"b","y":null}\n{"data":1}\n"text"\n', encoding="utf-8")
    t = session.table("t", create=True)
    t.load(str(lines))
    assert {r.key: r.raw for r in t.documents().collect()} == {key_of("a"): '{"x":1}', key_of("b"): '{"uuid":"b","y":null}'}
    t.dump(str(tmp_path / "out"))
    other = session.table("u", create=True)
    other.load(str(tmp_path / "out"))
    assert other.documents().select("key", F.to_json("v")).exceptAll(t.documents().select("key", F.to_json("v"))).count() == 0
    assert session.spark.read.parquet(t.log.backup(str(tmp_path / "backup"))).count() == 2
    session.run("INDEX CREATE t x")
    assert session.run("INDEX LIST t") == ["x"] and session.run("INDEX LIST nowhere") == []
    session.run("TRUNCATE t")
    assert session.run("COUNT t").first().n == 0 and session.run("INDEX LIST t") == []
    session.run("DROP TABLE t")
    assert session.run("TABLES") == ["u"]


def test_live_ranking_and_index_history(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), compat=True)
    key = lambda i: f"00000000-0000-0000-0000-{i:012x}"
    t.log.create()
    t.log.indexes["stats.kills"] = 0
    for i, kills in ((101, 50), (102, 350), (103, 150)):
        t.set(key(i), json.dumps({"stats": {"kills": kills}}))
    assert [r[1] for r in ranks(t.top("stats.kills"))] == [key(102), key(103), key(101)]
    t.set(key(101), '{"stats":{"kills":500}}')
    assert t.top("stats.kills", 1).first().asDict() == {"rank": 1, "uuid": key(101), "score": 500.0}
    t.set(key(102), '{"stats":{}}')  # the old score stays
    t.delete_where("stats.kills = 150")  # so does that of a document deleted by a filter
    t.delete(key(101))
    assert {r.key: r.score for r in index_scores(t.log.rows(), "stats.kills").collect()} == {key(102): 350.0, key(103): 150.0}


def test_stream_keeps_the_board(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    stream = BoardStream(spark, str(tmp_path / "state"), "x")
    for batch in ([("a", '{"x":1}'), ("b", '{"x":5}')], [("a", '{"x":9}'), ("b", None)], [("c", '{"x":2}')]):
        t.mset(batch)
        stream.start(read_log(spark, t.log.path), str(tmp_path / "ck")).awaitTermination()
        assert sorted(stream.board().collect()) == sorted(t.board("x").collect())


@pytest.mark.parametrize("line", ["", "NOPE t", "GET t", "MSET t a", "TOP t", "EXPIRE t k soon", "INDEX DROP t", "CREATE t", "RANK.RANGE t p 1", "SET t k"])
def test_bad_commands(line):
    with pytest.raises(CommandError):
        parse_command(line)


def test_parsing():
    assert parse_command("set T K  {\"a\": \"} b\"}").args == {"key": "K", "raw": '{"a": "} b"}'}
    assert parse_command('mset t a {"x":"}"} b 5').args["items"] == [("a", '{"x":"}"}'), ("b", "5")]
    assert parse_command("FILTER t level >= 50").args == {"query": "level >= 50", "limit": None}
    assert parse_command('FILTER t "level >= 50" 7').args == {"query": "level >= 50", "limit": 7}
    assert parse_command("FILTER t level >= 50 7").args == {"query": "level >= 50", "limit": 7}
    assert parse_command("range t - + 5").args == {"words": ["-", "+", "5"]}
    assert parse_command("STATS").table is None and parse_command("STATS t x").verb == "CALC_STATS"


def test_edits():
    assert set_member('{"b":1,"a":{"c":2}}', "a.d", [1]) == '{"a":{"c":2,"d":[1]},"b":1}'
    assert set_member(None, "x", 1) == set_member("oops", "x", 1) == set_member("[1]", "x", 1) == '{"x":1}'
    assert set_member('{"a":5}', "a.b", "é") == '{"a":{"b":"é"}}'
    assert [literal_value(x) for x in ("'5'", "5", "1.5", "true", "NULL", "{\"a\":1}", "words")] == ["5", 5, 1.5, True, None, {"a": 1}, "words"]


def test_reports(session):
    fill(session)
    t = session.table("players")
    from tarnfold import operators as ops

    assert {r.label for r in ops.search(t.documents(), "COINS").collect()} == {"herobrine", "alex", "steve"}
    assert [r.label for r in t.keys(2).collect()] == [r.label for r in t.keys().limit(2).collect()]
    assert t.find(" ALEX ").first().uuid == key_of("alex") == t.find(key_of("alex")).first().uuid
    row = session.details().first()
    assert (row.table, row.total_records, row.tombstones, row.size) == ("players", 4, 0, f"{row.value_bytes} B")
    sizes = session.spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 2**20,), (3 * 2**30,)], "n long")
    assert [r[0] for r in sizes.select(ops.byte_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3.00 GB"]
    numbers = session.spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    assert ops.percentiles(numbers, "x").first().asDict() == {"avg": 50.5, "min": 1.0, "max": 100.0, "p50": 51.0, "p90": 91.0, "p99": 100.0}
    assert ops.percentiles(numbers.limit(0), "x").first().p99 == 0.0


def test_labels_are_found_beyond_the_original_scan(spark, tmp_path):
    key = lambda i: f"00000000-0000-0000-0000-{i:012x}"
    t = Table(spark, str(tmp_path / "t"))
    t.log.create()
    t.mset((key(i), json.dumps({"name": f"n{i}"})) for i in range(10_001))
    assert [r.uuid for r in t.find("n10000").collect()] == [key(10_000)]
    assert Table(spark, str(tmp_path / "t"), compat=True).find("n10000").count() == 0


def test_scan_arguments():
    from tarnfold.operators.lookup import scan_arguments

    assert scan_arguments([]) == (None, None, None) and scan_arguments(["5"]) == (None, None, 5) and scan_arguments(["a"]) == ("a", None, None)
    assert scan_arguments(["0", "7"]) == ("0", None, 7) and scan_arguments(["a", "b"]) == ("a", "b", None) and scan_arguments(["a", "b", "3"]) == ("a", "b", 3)


def test_scans(session):
    fill(session)
    keys = sorted(key_of(n) for n, *_ in PLAYERS)
    ids = lambda line: [r.uuid for r in session.run(line).collect()]
    assert ids("SCAN players") == ids("SCAN players - +") == keys
    assert ids("SCAN players 2") == keys[:2] and ids(f"SCAN players {keys[1]} {keys[2]}") == keys[1:3]
    assert ids("SCAN players 0") == keys[:1]  # a limit of 0 counts as 1
    assert ids(f"SCAN players {keys[2]} {keys[1]}") == []


def test_batch_numbers_never_fall(spark, tmp_path):
    """Deletes and compactions leave no number to be given again, nor does a truncation."""
    t = Table(spark, str(tmp_path / "t"))
    t.set("a", "{}")
    t.set("b", '{"x":1}')
    t.delete("b")
    assert t.log.last_seq() == 3
    t.log.compact()
    t.set("c", "{}")
    assert t.log.last_seq() == 4 and max(r.seq for r in t.log.rows().collect()) == 4
    t.delete_where("x = 1")
    assert t.log.last_seq() == 5
    t.log.truncate()
    t.set("d", "{}")
    assert [r.seq for r in t.log.rows().collect()] == [t.log.last_seq()] and t.log.last_seq() > 5


def test_numbers_are_given_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tarnfold.sources.files import Counter, Folder

    counters = [Counter(Folder(spark, str(tmp_path / "seq"))) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        given = [n for part in pool.map(lambda c: [c.take() for _ in range(10)], counters) for n in part]
    assert len(set(given)) == 80 and counters[0].last() == max(given)


def test_a_board_outlives_compactions_and_new_checkpoints(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    stream = BoardStream(spark, str(tmp_path / "state"), "x")
    go = lambda ck="ck": stream.start(read_log(spark, t.log.path), str(tmp_path / ck)).awaitTermination()
    same = lambda: sorted(stream.board().collect()) == sorted(t.board("x").collect())
    t.mset([("a", '{"x":1}'), ("b", '{"x":5}'), ("d", '{"x":6}')])
    go()
    t.delete("b")
    t.log.compact()  # the delete is in no log file now
    t.set("c", '{"x":2}')
    go()
    assert same() and len(stream.board().collect()) == 3
    t.set("a", '{"x":9}')
    t.delete_where("x = 6")
    t.log.compact()
    t.set("b", '{"x":7}')  # back again
    t.log.compact()
    go()
    assert same() and t.log.gone().count() == 1
    t.set("a", '{"x":10}')
    go("another")
    assert same()


def test_index_registry_is_kept_with_the_table(spark, tmp_path):
    first = Session(spark, str(tmp_path / "db"), compat=True)
    first.run('SET t a {"stats":{"kills":1}}')
    first.run("INDEX CREATE t stats.kills")
    first.run('SET t b {"stats":{"kills":2}}')
    second = Session(spark, str(tmp_path / "db"), compat=True)
    assert second.run("INDEX LIST t") == ["stats.kills"]
    assert ranks(second.run("TOP t stats.kills 5")) == [(1, key_of("b"))]  # what was put after it was made


def test_compression_is_kept_and_unknown_names_are_the_default(spark, tmp_path):
    import pyarrow.parquet as pq

    db = Session(spark, str(tmp_path / "db"))
    db.run("CREATE TABLE t")
    assert [db.run(f"COMPRESSION t {x}") for x in ("zstd", "gzip", "None", "ZSTD")] == ["zstd", "lz4", "none", "zstd"]
    Session(spark, str(tmp_path / "db")).run("SET t a {}")
    codecs = {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in (tmp_path / "db/t/log-000000").glob("*.parquet") if pq.ParquetFile(p).metadata.num_row_groups}
    assert codecs == {"ZSTD"}
    assert Table(spark, str(tmp_path / "u"), compression="nonsense").log.compression() == "lz4"


def test_config_metrics_and_maintenance(session):
    assert session.run("CONFIG GET") == {"compaction_trigger": 4, "compression": "lz4"}
    assert session.run("CONFIG SET compaction_trigger 1")["compaction_trigger"] == 2  # moved into its range
    assert session.run("CONFIG SET compaction_trigger many")["compaction_trigger"] == 2  # passed over
    session.run("CONFIG SET compression zstd")
    with pytest.raises(CommandError):
        session.run("CONFIG SET colour red")
    fill(session)
    session.run("DEL players alex")
    assert session.table("players").log.compression() == "zstd"
    rows = {(r.metric, r.table): r.value for r in session.run("METRICS").collect()}
    assert rows["up", None] == 1 and rows["table_records", "players"] == 5 and rows["table_tombstones", "players"] == 1 and rows["table_keys", "players"] == 4
    assert rows["total_disk_bytes", None] >= rows["table_disk_bytes", "players"] > 0
    assert session.maintain() == ["players"] and session.table("players").log.rows().count() == 3
    with pytest.raises(CommandError, match="not supported"):
        session.run("AUTH secret")


def test_backup_and_restore(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    t = Table(spark, str(tmp_path / "t"), now=at("2024-01-01 00:00:00"))
    t.mset([("a", '{"x":1}'), ("b", "{}")])
    t.expire("a", 60)
    t.log.indexes["x"] = 1
    t.log.set_compression("zstd")
    copy = Table(spark, str(tmp_path / "copy"), now=at("2024-01-01 00:00:30"))
    copy.log.restore(t.log.backup(str(tmp_path / "backup")))
    assert copy.ttl("a") == 30 and copy.ttl("b") == -1 and dict(copy.log.indexes) == {"x": 1} and copy.log.compression() == "zstd"
    copy.set("c", "{}")
    assert copy.log.last_seq() > t.log.last_seq()


def test_labels_of_values_that_are_no_objects(spark):
    from tarnfold.functions import document, label_of

    rows = [
        ('"  Bob  "', "Bob"), ('"   "', "KEY"), ("plain text", "plain text"), (" \t padded\u00a0", "padded"), ('{"name":"\\t","title":"T"}', "T"), ('{"name":" x "}', " x "),
        ("5", "KEY"), ("[1]", "KEY"), ('"' + "y" * 65 + '"', "KEY"), ("y" * 64, "y" * 64), ("", "KEY"), ('{"name":5}', "KEY"), ("null", "KEY"), ('{"a":1} trailing', '{"a":1} trailing'),
    ]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("v", document(F.col("raw")))
    got = df.select("raw", "want", label_of(F.col("v"), F.lit("KEY"), F.col("raw")).alias("label")).collect()
    assert [(r.raw, r.label) for r in got] == rows


def test_textual_scores(spark):
    from tarnfold.functions import textual_score

    rows = [
        ('{"a":{"b":5}}', 5.0), ('{"a": {"b" :\n -1.5e2}}', -150.0), ('{"b":1,"a":{"c":0},"b":7}', 7.0), ('{"a":{"b":"5"}}', None), ('{"a":{"c":1}}', None),
        ('broken "a": "b": 3', 3.0), ('{"a":{"b":1.2.3}}', None), ('{"a":{"b":true}}', None), ('{"a":{"b":.5}}', 0.5), ("", None),
    ]
    df = spark.createDataFrame(rows, "raw string, want double")
    assert [tuple(r) for r in df.select("raw", textual_score(F.col("raw"), "a.b")).collect()] == rows


def test_web_limits(session):
    fill(session)
    t = session.table("players")
    keys = sorted(key_of(n) for n, *_ in PLAYERS)
    ids = lambda df: [r.uuid for r in df.collect()]
    assert ids(t.web_scan()) == ids(t.web_scan(" ", "", "x")) == keys and ids(t.web_scan(limit="2")) == keys[:2] and ids(t.web_scan(limit=0)) == []
    assert ids(t.web_scan(keys[1], keys[2])) == keys[1:3]
    assert len(ids(t.web_filter("stats.kills > 0", 5000))) == 4 and len(ids(t.web_filter("stats.kills > 0", "1"))) == 1
    from tarnfold.operators.lookup import web_limit

    assert [web_limit(x) for x in (None, "5000", "-1", "7", 1001)] == [100, 1000, 100, 7, 1000]


def test_live_scores_with_a_time_to_live(spark, tmp_path):
    from tarnfold.sources import SCHEMA
    from tarnfold.streaming import live_scores

    src = tmp_path / "src"

    def batch(*rows):
        spark.createDataFrame([(k, raw, seq, 0, ts, "PUT" if raw else "DEL") for k, raw, seq, ts in rows], "key string, raw string, seq long, batch_pos int, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))

    found = []
    take = lambda df, _: found.extend(tuple(r) for r in df.select("key", "score", "live").collect())

    def go():
        found.clear()
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        live_scores(stream, "x", 60).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(found)

    batch(("a", '{"x":1}', 1, "2024-01-01 00:00:00"), ("a", '{"x":3}', 3, "2024-01-01 00:00:01"), ("b", '{"x":5}', 2, "2024-01-01 00:00:00"))
    assert go() == [("a", 3.0, True), ("b", 5.0, True)]
    batch(("a", '{"x":2}', 2, "2024-01-01 00:00:02"), ("b", None, 4, "2024-01-01 00:00:03"))
    assert go() == [("b", 5.0, False)]  # an older change of a changes nothing
    batch(("c", '{"x":7}', 5, "2024-01-01 00:10:00"))
    got = go()
    assert ("c", 7.0, True) in got and ("a", 3.0, False) in got


def test_checksums(spark):
    import zlib

    from tarnfold.functions import checksum

    rows = [('{"a":1}',), ("é",), ("",), (None,)]
    got = spark.createDataFrame(rows, "raw string").select("raw", checksum(F.col("raw")).alias("c")).collect()
    assert [r.c for r in got] == [zlib.crc32((r[0] or "").encode()) for r in rows]
