"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded random order, served ``passes`` times over.  A
document's virtual finish time is the number of words its queue has served once it is through, divided
by the source's target.  Sorted by that time over all sources, the queue that is furthest behind its
share goes next; the mix is what comes first, up to the total budget, which is spent at time 1.  A document
that is in service at time 1 stands in that order in two parts, with a finish time each, so that the cut
leaves every source at its target.

The running sums are taken in two levels, so that neither a source nor the mix is sorted in one task: words per
slice first, then within a slice.  A third level would be wanted beyond some ten billion documents, where the
sums per slice no longer suit one task.

Rows that agree in doc_id, source and size are interchangeable: they are counted first and then told apart by a
number, so that no window holds the rows of a doc_id, however many there are.

Defined results: a null text has 0 words; a null source is a source of its own, sorted last; a very long text is
one document, which may be taken in part; repeated rows and ties of doc_id are documents like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
#: Documents per slice of a source's random order, as an average.
SLICE_ROWS = 2000
#: Equal rows that are dealt together.
CHUNK = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source_size and target.

    Targets are ``min(cap, level * weight)`` with the one level at which they add up to the budget; that
    is where resharing an excess by weight ends.  With sources in order of cap / weight, the level is
    (budget - caps before) / (weights from here on), at the first source that it leaves under its cap.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    total = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - before) / onward
    total = total.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    total = total.withColumn("level", F.max(fits).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return total.select("source", "source_size", "n_docs", target.alias("target"))


def numbered(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, row_no): equal rows counted, and dealt again with a number each.

    ``more`` columns take part.  Counts beyond CHUNK are dealt in parts, so that many copies don't meet in one task.
    """
    keys = ["doc_id", "source", "size", *more]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    many = counted.where(F.col("_n") > CHUNK).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    few = counted.where(F.col("_n") <= CHUNK).withColumn("_from", F.lit(0).cast("long"))
    parts = few.unionByName(many.repartition(*keys, "_from"))
    last = F.least(F.col("_from") + CHUNK, F.col("_n")) - 1
    return parts.withColumn("row_no", F.explode(F.sequence(F.col("_from"), last))).drop("_from", "_n")


def queued(sizes: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The parts of (doc_id, source, size, row_no and others) rows as they stand in their source's queue.

    Adds source_size, target, ``copy`` (the pass, from 0), the ``words`` of a part and its virtual ``finish`` time.  A
    document is one part in each pass, but for the one in service when its source comes to its target: that has two.
    """
    keys = [c for c in sizes.columns if c != "source"]
    # an equi-join, null included: Spark broadcasts the targets if they are small, and splits hot sources if not
    targets = source_targets(sizes, weights, share, passes).withColumnRenamed("source", "_source")
    queue = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    queue = queue.withColumn("dice", F.xxhash64(F.lit(seed), "copy", *keys))
    queue = queue.withColumn("slice", F.pmod("dice", F.ceil(F.col("n_docs") / F.lit(float(SLICE_ROWS)))))
    queue = _running(queue, ["source", "copy"], "slice", ["dice", *keys], "size", over=["source"], steps=["copy", "slice"])
    through, goal = F.col("before") + F.col("size"), whole_words(F.col("target"))
    one = F.array(F.col("size"))
    parts = F.when((F.col("before") < goal) & (through > goal), F.array(goal - F.col("before"), through - goal)).otherwise(one)
    queue = queue.select("*", F.posexplode(parts).alias("part", "words"))
    done = F.when(F.col("part") == 1, through).otherwise(F.col("before") + F.col("words"))
    spread = F.pmod(F.col("dice"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    finish = F.when(goal > 0, done / goal).otherwise(F.lit(2.0) + spread)  # beyond the budget, if it is to have less than a word
    return queue.select(*sizes.columns, "source_size", "target", "copy", "part", "words", finish.alias("finish"))


def whole_words(target: Column) -> Column:
    return F.floor(target + 1e-6)


def mix(sizes: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix of (doc_id, source, size, row_no and others) rows: their parts in order, and what the budget takes of them.

    Adds to queued() ``position``, the words before a part in the order of virtual finish times, and ``taken``, those of
    its words that are within the total budget.  ``sizes`` is read twice, so it should be a stored table.
    """
    queue = stored(queued(sizes, seed, weights, share, passes), "queue")
    goals = queue.groupBy("source").agg(F.first("target").alias("target"))
    found = goals.agg(F.coalesce(F.sum(whole_words(F.col("target"))), F.lit(0)).cast("long").alias("budget")).first()
    rows = in_order(queue)
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(found["budget"]) - F.col("position"))).cast("long"))


def _running(rows: DataFrame, groups: list, part: str, order: list, amount: str, over: list, steps: list) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows of the same ``over`` that come earlier by ``steps``, then ``order``."""
    cells = [*groups, part]
    ahead = rows.groupBy(*cells).agg(F.sum(amount).alias("_cell"))
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_cell").over(W.partitionBy(*over).orderBy(*steps).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum(amount).over(W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0)))
    ahead = ahead.select(F.col("_ahead"), *[F.col(c).alias(f"_{c}") for c in cells])
    both = rows.join(ahead, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cells])
    return both.withColumn("before", F.col("_ahead") + F.col("_within")).drop("_ahead", "_within", *[f"_{c}" for c in cells])


def in_order(queue: DataFrame) -> DataFrame:
    """Adds ``position`` to queued(): the words before a part in the order of virtual finish times.

    Ranges of the finish time are sorted one by one; their totals say where each begins.  Beyond time 1 they are ranges of
    its logarithm, as a large source with a small target has much of its queue far out.
    """
    found = queue.agg(F.count("*").alias("n"), F.coalesce(F.max("finish"), F.lit(1.0)).alias("latest")).first()
    n_ranges = max(1, -(-found["n"] // SLICE_ROWS))
    late = 1 + F.log2(F.greatest(F.col("finish"), F.lit(1.0))) / F.lit(max(1.0, math.log2(max(1.0, found["latest"]))))
    rows = queue.withColumn("range", F.floor(F.when(F.col("finish") <= 1, F.col("finish")).otherwise(late) * F.lit(n_ranges)))
    keys = [c for c in queue.columns if c not in ("words", "finish", "target", "source_size")]
    return _running(rows, [], "range", ["finish", *keys], "words", over=[], steps=["range"]).withColumnRenamed("before", "position").drop("range")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text and others) with each row as often as the mix takes it; one that it takes in part counts if that is half of it or more.

    Rows that are equal in all columns are one, with a number of copies, so that it doesn't matter which of them is
    kept; their digest stands for them in the mix.  Texts are shuffled once, by that digest, copies dropped first.
    """
    missing = F.concat(*[F.col(c).isNull().cast("string") for c in docs.columns])  # the hash passes over nulls
    digest = F.struct(F.xxhash64(missing, *docs.columns).alias("a"), F.xxhash64(F.lit(99), missing, *docs.columns).alias("b"))
    sizes = stored(numbered(docs.select("doc_id", "source", size_of().alias("size"), digest["a"].alias("_a"), digest["b"].alias("_b")), "_a", "_b"), "sizes")
    each = mix(sizes).groupBy("_a", "_b", "row_no", "copy").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
    times = each.where((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))).select("_a", "_b")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), digest["a"].alias("_a"), digest["b"].alias("_b"))
    rows = rows.groupBy("_a", "_b").agg(F.first("doc").alias("doc"))
    return rows.join(times.hint("merge"), ["_a", "_b"]).select("doc.*")


def op1_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of().alias("size"))
    per_doc = ["doc_id", "source", "row_no", "size", "source_size", "target"]
    rows = mix(stored(numbered(docs), "sizes"))
    position = F.min(F.when(F.col("taken") > 0, F.col("position"))).alias("position")
    return rows.groupBy(*per_doc).agg(F.sum("taken").alias("taken"), position).drop("row_no", "source")
