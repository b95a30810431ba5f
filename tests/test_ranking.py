import uuid

import pytest

from tarnfold import operators as ops

PLAYERS = [(str(uuid.UUID(int=i)), float(i * 10)) for i in range(1, 101)]


@pytest.fixture(scope="module")
def board(spark):
    return spark.createDataFrame(PLAYERS, "key string, score double").cache()


def rows(df):
    return [(r["rank"], int(uuid.UUID(r["uuid"])), r["score"]) for r in df.collect()]


def test_hundred_players(board):
    key = lambda i: str(uuid.UUID(int=i))
    assert [r[2] for r in rows(ops.top_n(board, 5))] == [1000.0, 990.0, 980.0, 970.0, 960.0]
    assert [r[0] for r in rows(ops.rank_range(board, 30, 50))] == list(range(30, 51))
    assert [r[0] for r in rows(ops.around_key(board, key(50), 10))] == list(range(46, 56))
    assert [r[0] for r in rows(ops.around_score(board, 700, 10))] == list(range(26, 36))
    assert [(r[0], r[2]) for r in rows(ops.score_range(board, 50, 100))] == [(91 + i, 100.0 - 10 * i) for i in range(6)]
    assert ops.rank_of_key(board, key(50)).first().asDict() == {"rank": 51, "uuid": key(50), "score": 500.0, "total_ranked": 100}


def test_ends_and_empty_requests(board):
    key = lambda i: str(uuid.UUID(int=i))
    assert [r[0] for r in rows(ops.around_key(board, key(100), 4))] == [1, 2, 3, 4]
    assert [r[0] for r in rows(ops.around_key(board, key(1), 4))] == [97, 98, 99, 100]
    assert [r[0] for r in rows(ops.around_score(board, -5, 3))] == [98, 99, 100]
    assert len(rows(ops.around_key(board, key(7), 1000))) == 100
    for empty in (ops.top_n(board, 0), ops.rank_range(board, 0, 5), ops.rank_range(board, 6, 5), ops.score_range(board, 9, 1), ops.around_key(board, "nobody"), ops.rank_of_key(board, "nobody"), ops.around_score(board, 5, 0), ops.rank_range(board, 101, 120)):
        assert empty.count() == 0
    for bad in (lambda: ops.around_score(board, float("nan")), lambda: ops.score_range(board, float("nan"), 1)):
        with pytest.raises(ValueError):
            bad()


def test_ties_go_to_the_greater_key(spark):
    board = spark.createDataFrame([(str(uuid.UUID(int=i)), float(i // 4)) for i in range(40)], "key string, score double")
    whole = sorted(((s, k) for k, s in board.collect()), reverse=True)
    want = [(i + 1, int(uuid.UUID(k)), s) for i, (s, k) in enumerate(whole)]
    assert rows(ops.top_n(board, 40)) == want == rows(ops.rank_range(board, 1, 40)) == rows(ops.score_range(board, -1, 100))
    for rank, k, _ in want[::7]:
        assert ops.rank_of_key(board, str(uuid.UUID(int=k))).first()["rank"] == rank


@pytest.mark.parametrize("kind", ["distinct", "few", "one", "skewed"])
def test_deep_ranks_begin_at_an_anchor(spark, kind):
    """Any stretch is that of a sort of all rows, whatever the scores are."""
    from pyspark.sql import functions as F

    score = {"distinct": F.col("id") * 1.5, "few": F.col("id") % 3, "one": F.lit(7.0), "skewed": F.when(F.col("id") % 10 < 8, 5.0).otherwise(F.col("id") % 100)}[kind]
    key = F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 8), F.lit("-0000-0000-0000-000000000000"))
    board = spark.range(6000).select(key.alias("key"), score.cast("double").alias("score"))
    whole = sorted(((r.score, r.key) for r in board.collect()), reverse=True)
    want = [(i + 1, k, s) for i, (s, k) in enumerate(whole)]
    table = ops.written(board)
    for first, last in ((101, 130), (2990, 3010), (4795, 4810), (5990, 6000), (5999, 7000), (1, 200), (6001, 6005)):
        got = [(r["rank"], r["uuid"], r["score"]) for r in ops.rank_range(table, first, last, near=60).collect()]
        assert got == want[first - 1 : last], (first, last)
    assert [ops.score_at(table, i, near=60) for i in (1, 3000, 6000)] == [whole[i - 1][0] for i in (1, 3000, 6000)]


def test_a_deep_rank_has_no_offset_and_a_short_sort(spark):
    """Rank 500,000 of a million: the sort keeps the rows between the anchor and the last rank only."""
    import re

    from pyspark.sql import functions as F

    board = spark.range(1_000_000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("")).alias("key"), (F.xxhash64("id") % 10**9).cast("double").alias("score"))
    df = ops.rank_range(ops.written(board), 500_000, 500_010)
    plan = df._jdf.queryExecution().executedPlan().toString()
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert "offset" not in plan.lower() and limits and max(limits) <= 10_011
    assert [r["rank"] for r in df.collect()] == list(range(500_000, 500_011))


def test_no_operator_sorts_the_whole_board_in_one_task(board):
    table = ops.written(board)
    for df in (ops.top_n(board, 5), ops.rank_range(board, 30, 50), ops.score_range(table, 50, 100)):
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_what_is_written_on_the_way_goes(spark, board, tmp_path):
    """Few rows are taken from a table that was written for them; of many asked for, and of scratch tables that are kept, the files stay."""
    import os

    from tarnfold import shared

    folder = f"{shared.shared_folder(spark)}/session-{shared._SESSION}"
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    for df in (ops.rank_of_key(board, str(uuid.UUID(int=50))), ops.around_score(board, 700, 10), ops.score_range(board, 50, 100), ops.rank_range(board, 60, 70, near=20)):
        assert df.count() and there() == before
    with shared.scratch() as keep:
        one, two = shared.stored(board, "one"), keep(shared.stored(board, "two"))
    assert two.count() == 100 and len(there() - before) == 1 and one is not two
    shared.released(two)
    assert there() == before
