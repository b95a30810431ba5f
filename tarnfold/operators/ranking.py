"""Leaderboards over (key, score).  Rank 1 has the highest score; ties go to the greater key.

No operator ranks the whole table: a rank is a count of what comes before, a stretch of ranks is a bounded
sort.  A stretch far down begins at an anchor, a score (and among equal scores a part of the keys) with not many
rows of the board between it and the first rank asked for; counts find it.  What is looked at more than once is
written first, as (key, score), so that documents are parsed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import key_of, score
from ..shared import is_stored, released, stored

#: Ranks up to which a stretch is cut from the top, and the most rows between an anchor and a rank.
NEAR = 10_000
#: Scores that are counted at a time.
PARTS = 32
TOP_LIMIT, RANGE_LIMIT, MOST = 10, 50, 1000


def _best():
    return F.desc("score"), F.desc("key")


def scored(docs: DataFrame, path: str) -> DataFrame:
    """(key, score) of the documents that have a number at the path.

    A generator drops the others: a filter would be pushed below, and read every document twice.
    """
    found = F.array(F.struct(score(F.col("v"), path).alias("score")))
    return docs.select("key", F.inline(F.filter(found, lambda s: s["score"].isNotNull())))


def written(board: DataFrame) -> DataFrame:
    """The board as a table of (key, score), for several looks at it."""
    return board if is_stored(board) else stored(board.select("key", "score"), "board")


def _settled(rows: DataFrame, table: DataFrame, board: DataFrame, most: int) -> DataFrame:
    """``rows``, ``most`` of them: if they are few, they are taken from a table that was written for them, which then goes."""
    if table is board or most > NEAR:
        return rows
    found = rows.collect()
    released(table)
    return rows.sparkSession.createDataFrame(found, rows.schema)


def _board(rows: DataFrame, before: int) -> DataFrame:
    """Numbers a bounded set of rows, ``before`` of which rank ahead of it."""
    place = F.row_number().over(W.orderBy(*_best())) + F.lit(before)
    return rows.select(place.cast("long").alias("rank"), F.col("key").alias("uuid"), "score").orderBy("rank")


def _limit(limit: int | None, default: int, most: int | None) -> int:
    n = default if limit is None else max(0, limit)
    return n if most is None else min(n, most)


def top_n(board: DataFrame, limit: int | None = None, most: int | None = MOST) -> DataFrame:
    """The best ``limit`` (10; 1000 at most)."""
    return _board(board.orderBy(*_best()).limit(_limit(limit, TOP_LIMIT, most)), 0)


def rank_of_key(board: DataFrame, key: str) -> DataFrame:
    """One row: rank, uuid, score and total_ranked; none if the key has no score.

    The key's score is looked up first; a single pass then counts what beats it.
    """
    k = key_of(key)
    table = written(board)
    own = table.where(F.col("key") == k).select("score").first()
    s = F.lit(float(own["score"]) if own else 0.0)
    better = (F.col("score") > s) | ((F.col("score") == s) & (F.col("key") > k))
    one = table.agg((F.count_if(better) + 1).alias("rank"), F.lit(k).alias("uuid"), s.alias("score"), F.count("*").alias("total_ranked"))
    return _settled(one if own else one.limit(0), table, board, 1)


def rank_range(board: DataFrame, first: int, last: int, near: int = NEAR) -> DataFrame:
    """Ranks ``first`` to ``last``, both included; empty if first is 0 or beyond last.  As long as asked for.

    Up to ``near`` they are cut from the top; further down from an anchor as near as that.
    """
    if first < 1 or first > last:
        return _board(board.limit(0), 0)
    table, before = board, 0
    if last > near:
        table = written(board)
        if table.count() < first:
            return _settled(_board(table.limit(0), 0), table, board, 0)
        onward, before = _anchor(table, first, near)
        rows = table.where(onward)
    else:
        rows = table
    return _settled(_board(rows.orderBy(*_best()).limit(last - before), before).where(F.col("rank") >= first), table, board, last - first + 1)


def score_at(board: DataFrame, rank: int, near: int = NEAR) -> float:
    """The score at a rank that the board has."""
    onward, before = _anchor(board, rank, near)
    return board.where(onward).orderBy(F.desc("score")).limit(rank - before).agg(F.min("score")).first()[0]


def _anchor(board: DataFrame, rank: int, near: int) -> tuple[Column, int]:
    """Which rows to go on with, and how many of the board come before them: fewer than ``rank``, by ``near`` at most.

    Scores that part the rows evenly are counted, and so on between the two that the rank is between.  If it is
    among equal scores, their keys are counted by how they begin.
    """
    rows, onward, before = board, F.lit(True), 0
    while rank - before > near:
        points = F.percentile_approx("score", [i / PARTS for i in range(PARTS + 1)], 10_000)
        found = rows.agg(points.alias("p"), F.max("score").alias("high"), F.min("score").alias("low")).first()
        scores = sorted({found["high"], found["low"], *found["p"]}, reverse=True)
        counts = rows.agg(*[F.count_if(F.col("score") >= s if at else F.col("score") > s).alias(f"c{i}{at}") for i, s in enumerate(scores) for at in (0, 1)]).first()
        i = next(i for i in range(len(scores)) if before + counts[f"c{i}1"] >= rank)
        if before + counts[f"c{i}0"] < rank:  # among those with this very score
            s = F.lit(scores[i])
            return _anchor_of_keys(board.where(F.col("score") == s), rank, near, F.col("score") < s, F.col("score") == s, before + counts[f"c{i}0"])
        before += counts[f"c{i - 1}1"]
        onward = F.col("score") < F.lit(scores[i - 1])
        rows = board.where(onward & (F.col("score") > F.lit(scores[i])))
    return onward, before


def _anchor_of_keys(ties: DataFrame, rank: int, near: int, lower: Column, equal: Column, before: int) -> tuple[Column, int]:
    """The same among rows of one score, by the first characters of their keys: up to 16 ** 4 beginnings at a time."""
    keys, width = F.lit(True), 0
    while rank - before > near and width < 36:
        width += 4
        begin = F.substring("key", 1, width)
        found = ties.groupBy(begin.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
        for r in found:
            if before + r["n"] >= rank:
                keys = begin <= F.lit(r["b"])
                ties = ties.where(begin == F.lit(r["b"]))
                break
            before += r["n"]
    return lower | (equal & keys), before


def _around(board: DataFrame, centre: int, total: int, limit: int) -> DataFrame:
    """``limit`` rows around a rank, moved back where the board ends."""
    if not limit or not total:
        return rank_range(board, 0, 0)
    first = max(1, centre - limit // 2)
    last = first + limit - 1
    if last > total:
        first, last = max(1, total - limit + 1), total
    return rank_range(board, first, last)


def around_key(board: DataFrame, key: str, limit: int | None = None, most: int | None = MOST) -> DataFrame:
    """``limit`` (10; 1000 at most) rows with the key in their middle; empty if it has no score.  The key's rank is looked up first."""
    table, n = written(board), _limit(limit, TOP_LIMIT, most)
    own = rank_of_key(table, key).first()
    return _settled(_around(table, own["rank"], own["total_ranked"], n) if own else rank_range(table, 0, 0), table, board, n)


def around_score(board: DataFrame, target: float, limit: int | None = None, most: int | None = MOST) -> DataFrame:
    """``limit`` (10; 1000 at most) rows around the place where a score would be."""
    if math.isnan(target):
        raise ValueError("a score can't be NaN")
    table, n = written(board), _limit(limit, TOP_LIMIT, most)
    found = table.agg(F.count_if(F.col("score") > target).alias("above"), F.count("*").alias("total")).first()
    return _settled(_around(table, min(found["total"], found["above"] + 1), found["total"], n), table, board, n)


def score_range(board: DataFrame, low: float, high: float, limit: int | None = None, most: int | None = MOST) -> DataFrame:
    """The best ``limit`` (50; 1000 at most) of the scores from low to high, both included, with their ranks on the whole board."""
    if math.isnan(low) or math.isnan(high):
        raise ValueError("a score can't be NaN")
    if low > high:
        return rank_range(board, 0, 0)
    table, n = written(board), _limit(limit, RANGE_LIMIT, most)
    above = table.agg(F.count_if(F.col("score") > high)).first()[0]
    rows = table.where(F.col("score").between(low, high)).orderBy(*_best()).limit(n)
    return _settled(_board(rows, above), table, board, n)


def rankings(board: DataFrame, mode: str = "top", limit: int = 50, key: str | None = None, score: float = 0.0, low: float = -math.inf, high: float = math.inf, first: int = 1, last: int = 50) -> DataFrame:
    """The leaderboard operators by the name of a mode, without a cap on the limit; an unknown mode is the top."""
    if mode == "around_key":
        return around_key(board, key, limit, None) if key and key.strip() else rank_range(board, 0, 0)
    if mode == "around_score":
        return around_score(board, score, limit, None)
    if mode == "score_range":
        return score_range(board, low, high, limit, None)
    if mode == "rank_range":
        return rank_range(board, first, last)
    return top_n(board, limit, None)
