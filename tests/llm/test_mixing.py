import collections
import re

import pytest
from pyspark.sql import functions as F

from tarnfold.llm import mixing
from tarnfold.llm.common import stored


def filled(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing round by round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total, extra = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= cap * sizes[s]:
                extra += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        left = extra
    return target


def test_targets_and_shares(spark, odd, texts):
    rows = mixing.op1_weighted_fair_queueing(spark, odd).collect()
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in rows) == sorted(size(r.text) for r in docs)
    sizes = collections.Counter()
    for r in docs:
        sizes[r.source] += size(r.text)
    want = filled(sizes, mixing.WEIGHTS)
    by_target = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_target[r.source_size, round(r.target, 3)] += r.taken
    assert {(sizes[s], round(t, 3)) for s, t in want.items()} == set(by_target)
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_target.items())


def sized(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", mixing.size_of().alias("size"))
    return stored(mixing.numbered(docs), "sizes")


def test_real_sources_come_to_their_targets(spark, sf):
    mix = mixing.mix(sized(spark, sf))
    rows = mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(rows) == 20 and all(abs(r.taken - r.target) <= 1 and r.target <= 2 * r["size"] for r in rows)
    assert sum(r.target for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_order_is_by_finish_and_fair_all_along(spark, sf):
    rows = mixing.mix(sized(spark, sf)).where("taken > 0").orderBy("position").collect()
    total = 0
    for r in rows:  # positions run on without a gap
        assert r.position == total and r.taken == r.words
        total += r.taken
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    half = collections.Counter()
    for r in rows:
        if r.position + r.taken <= total / 2:
            half[r.source] += r.taken
    longest = max(r.size for r in rows)
    assert all(abs(half[s] - t / 2) <= 2 * longest for s, t in {r.source: r.target for r in rows}.items())


def serve(docs, target, seed=17):
    """Words taken of (doc_id, source, size, row_no, first and second dice), source by source: each queue in the order of its dice."""
    taken = collections.Counter()
    for source, goal in target.items():
        left = int(goal + 1e-6)
        for copy in (0, 1):
            n = sum(d[1] == source for d in docs)
            slices = -(-n // mixing.SLICE_ROWS)
            for d in sorted((d for d in docs if d[1] == source), key=lambda d: (d[4 + copy] % slices, d[4 + copy])):
                words = min(left, d[2])
                taken[d[0], d[1], d[2], d[3]] += words
                left -= words
    return taken


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_every_document_is_taken_as_by_serving_the_queues_one_by_one(spark, request, which):
    sizes = sized(spark, request.getfixturevalue(which))
    dice = [F.xxhash64(F.lit(17), F.lit(c), "doc_id", "size", "row_no").alias(f"dice{c}") for c in (0, 1)]
    docs = [tuple(r) for r in sizes.select("doc_id", "source", "size", "row_no", *dice).collect()]
    by_source = collections.Counter()
    for d in docs:
        by_source[d[1]] += d[2]
    want = serve(docs, filled(by_source, mixing.WEIGHTS))
    got = mixing.mix(sizes).groupBy("doc_id", "source", "size", "row_no").agg(F.sum("taken").alias("taken")).collect()
    assert {tuple(r)[:4]: r.taken for r in got} == {d[:4]: want[d[:4]] for d in docs}


def test_equal_rows_get_numbers_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    df = spark.createDataFrame([(1, "a", 5)] * 30 + [(None, None, 0)] * 15 + [(2, "a", 5)], "doc_id long, source string, size long")
    rows = mixing.numbered(df).collect()
    assert sorted(r.row_no for r in rows if r.doc_id == 1) == list(range(30)) and sorted(r.row_no for r in rows if r.doc_id is None) == list(range(15)) and len(rows) == 46


def test_a_hot_source_and_copies_of_one_row(spark):
    """A third of all rows are one row; a source with nearly all words is taken in small part."""
    rows = [(7, "big", "same text here", 1)] * 400 + [(100 + i, "big", "w " * (i % 9 + 1), i) for i in range(600)] + [(9000 + i, "small", "x y z", None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra long")
    copies = collections.Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert all(copies[9000 + i] <= 2 for i in range(20)) and 0 < copies[7] <= 800 and max(n for i, n in copies.items() if i != 7) <= 2
    words = collections.Counter()
    for r in mixing.mixed(df).collect():
        words[r.source] += len(r.text.split())
    target = filled({"big": sum(len(r[2].split()) for r in rows if r[1] == "big"), "small": 60}, mixing.WEIGHTS)
    assert all(abs(words[s] - t) <= 9 for s, t in target.items())


def test_mixed_rows_keep_their_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert set(out.select("text").distinct().collect()) <= set(docs.select("text").distinct().collect())
    copies = collections.Counter(map(str, out.select("doc_id", "text", "source").collect()))
    there = collections.Counter(map(str, docs.select("doc_id", "text", "source").collect()))
    assert copies and all(n <= 2 * there[r] for r, n in copies.items())
