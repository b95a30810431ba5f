import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import document, numeric
from tarnfold.functions.values import allow_repeated_members
from tarnfold.plans import FilterError, compile_filter, parse_filter

FLAT = '{"name":"Alex","level":42,"active":true,"tags":["pro","vip"]}'
NESTED = '{"stats":{"kills":150,"deaths":10},"status":"online"}'
CASES = [
    (FLAT, "level >= 40", True), (FLAT, "level < 40", False), (FLAT, 'name == "Alex"', True), (FLAT, "active == true", True),
    (FLAT, 'tags CONTAINS "vip"', True), (FLAT, "missing != 1", True), (FLAT, "missing == null", False), (FLAT, "name > 1", False),
    (FLAT, 'level == "42"', False), (FLAT, 'level != "42"', True), (FLAT, 'name CONTAINS "le"', True), (FLAT, 'tags CONTAINS "vi"', False),
    (FLAT, "level = 42.0000000001", True), (FLAT, "level > -inf", True), (FLAT, "level != nan", False), (FLAT, "missing != nan", True),
    (NESTED, "stats.kills > 100 AND stats.deaths <= 20", True), (NESTED, "status == 'offline' OR stats.kills > 100", True),
    ("not json", "a != 1", False), ('{"a":1} x', "a = 1", False), ('{"a":null}', "a = null", True), ('{"a":null}', "a != null", False),
    ('{"a":1,"a":2}', "a = 2", True), ('{"a":1e999}', "a > 1", False), ('{"a.b":1}', "a.b = 1", False), ('{"":{"x":3}}', ".x = 3", True),
    ('{"a":"x AND y"}', "a = 'x AND y'", True), ('{"name":"a>=b"}', 'name == "a>=b"', True), ("[1]", "a != 1", True), (None, "a != 1", False),
]


def holds(spark, rows):
    allow_repeated_members(spark)
    queries = list(dict.fromkeys(q for _, q in rows))
    docs = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string").withColumn("v", document(F.col("raw")))
    got = {}
    for at in range(0, len(queries), 40):
        part = queries[at : at + 40]
        found = docs.select("i", *[compile_filter(q, F.col("v")).alias(f"q{k}") for k, q in enumerate(part)]).collect()
        got |= {(r.i, q): r[f"q{k}"] for r in found for k, q in enumerate(part)}
    return [got[i, q] for i, (_, q) in enumerate(rows)]


def test_fixtures(spark):
    assert holds(spark, [(r, q) for r, q, _ in CASES]) == [x for _, _, x in CASES]


def model(raw, tests):
    """The language in plain Python."""
    try:
        doc = json.loads(raw, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)

    def one(t):
        v, there = doc, True
        for part in t.path.split("."):
            there = there and isinstance(v, dict) and part in v
            v = v[part] if there else None
        if t.op in "!=":
            if isinstance(t.value, float) and math.isnan(t.value) and there and number(v):
                return False
            if t.value is None:
                same = there and v is None
            elif isinstance(t.value, float):
                same = there and number(v) and abs(v - t.value) < 1e-9
            else:
                same = there and type(v) is type(t.value) and v == t.value
            return same if t.op == "=" else not same
        if t.op == "CONTAINS":
            return there and isinstance(t.value, str) and ((isinstance(v, str) and t.value in v) or (isinstance(v, list) and any(isinstance(e, str) and e == t.value for e in v)))
        if not (there and number(v) and isinstance(t.value, float)) or math.isnan(t.value):
            return False
        return {">": v > t.value, ">=": v >= t.value, "<": v < t.value, "<=": v <= t.value}[t.op]

    return any(all(one(t) for t in part) for part in tests)


def test_random_documents_against_the_model(spark):
    dice = random.Random(8)
    atoms = [1, 2.5, -3, 0, "1", "x", "xy", "", True, False, None, [], ["x", 1], {"b": 1}, {"b": "x"}, 10**17, 1.0000000001]
    raws = [json.dumps({m: dice.choice(atoms) for m in ("a", "c", "d") if dice.random() < 0.8}) for _ in range(60)] + ["oops", "5", '"a"', "null", "[1]"]
    literals = ["1", "2.5", "-3", "'x'", '"xy"', "true", "null", "nan", "inf", "bare", "1.0000000001", "'1'"]
    simple = [f"{p} {op} {v}" for p in ("a", "a.b", "c") for op in ("=", "!=", ">", ">=", "<", "<=", "CONTAINS") for v in literals]
    joined = [f" {dice.choice(['AND', 'OR'])} ".join(dice.sample(simple, dice.randint(2, 4))) for _ in range(40)]
    queries = dice.sample(simple, 80) + joined
    rows = [(r, q) for q in queries for r in raws]
    allow_repeated_members(spark)
    docs = spark.createDataFrame([(r,) for r in raws], "raw string").withColumn("v", document(F.col("raw")))
    wrong = []
    for at in range(0, len(queries), 30):
        part = queries[at : at + 30]
        for r in docs.select("raw", *[compile_filter(q, F.col("v")).alias(f"q{k}") for k, q in enumerate(part)]).collect():
            wrong += [(r.raw, q, r[f"q{k}"]) for k, q in enumerate(part) if r[f"q{k}"] != model(r.raw, parse_filter(q))]
    assert len(rows) > 7000 and not wrong[:5]


def test_promoted_columns_agree_and_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("v", F.parse_json(F.to_json(F.struct("event_type", "user_id", "value"))))
    promoted = {"event_type": (F.col("event_type"), "string"), "user_id": (F.col("user_id"), "bigint"), "value": (F.col("value"), "double")}
    for q in ("value > 100 AND event_type = 'click'", "user_id = 3 OR value <= 5", "value != 7", "event_type CONTAINS 'ic'", "user_id = 'x'", "value != nan"):
        slow, fast = (events.where(compile_filter(q, F.col("v"), p)).count() for p in (None, promoted))
        assert slow == fast, q
    plain = spark.read.parquet(f"{sf}/events.parquet").withColumn("v", F.try_parse_json("props"))
    plan = plain.where(compile_filter("value > 100", F.col("v"), promoted)).select("event_id")._jdf.queryExecution().toString()
    assert "GreaterThan(value,100.0)" in plan and "props" not in plan.split("ReadSchema")[-1]


def test_compat_reading():
    assert parse_filter('name == "a>=b"', compat=True)[0][0].path == 'name == "a'
    with pytest.raises(FilterError):
        parse_filter("a = 'x AND y'", compat=True)
    for bad in ("", "  ", "a", "= 1", "a ="):
        with pytest.raises(FilterError):
            parse_filter(bad)


def test_numeric_strings(spark):
    allow_repeated_members(spark)
    raws = ['{"x":5}', '{"x":"5"}', '{"x":" 5"}', '{"x":"5d"}', '{"x":"NaN"}', '{"x":"1e3"}', '{"x":true}', '{"x":null}', "{}", '{"x":"1e999"}', '{"x":".5"}']
    docs = spark.createDataFrame([(r,) for r in raws], "raw string").select(numeric(document(F.col("raw")), "x").alias("x"))
    assert [r.x for r in docs.collect()] == [5.0, 5.0, None, None, None, 1000.0, None, None, None, None, 0.5]
