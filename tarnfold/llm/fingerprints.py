"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraphs: its lines, cut after sentences.  Each paragraph hashes to a wide
vector of signs, one a lane, and the fingerprint is the lane-wise sum modulo 2**20 with the number of
paragraphs.  So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding
or subtracting its vector.  Equal multisets have equal sums, and others don't but for hash collisions;
as signs of different paragraphs are independent, products of two fingerprints also estimate what two
texts share.

Three lanes are held in one 63-bit word, 21 bits apart, as counts of ones; a count below 2**20 doesn't
reach the next lane, so that whole words are added.

All of it is DataFrame expressions.  Defined results: a null text is empty, and an empty text is one
empty paragraph; documents are followed by the next lower doc_id, rows of one doc_id by each other in
the order of their digests, null doc_ids come last, and the last document is followed by the first (a
single document by itself); repeated rows are documents like any other, each followed by the next of them;
a very long text has as many paragraphs as it has, lanes and likeness hold beyond 2**20 of them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, whole_text
from .spans import let, sha256

#: 63 lanes come from each of these hashes of a paragraph.
SEEDS = (42, 4242)
_SPACING = 21
_ONES = sum(1 << _SPACING * i for i in range(3))
_MODULO = sum(((1 << 20) - 1) << _SPACING * i for i in range(3))
PARAGRAPH_END = r"\n|(?<=[.!?])\x20"
#: Documents in a bucket of neighbours, as an average, at least; the most buckets; and rows drawn for each bucket's limit.
BUCKET_ROWS, BUCKETS, DRAWN = 512, 65_536, 32


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_END, -1)


def fingerprint(parts: Column) -> Column:
    """array<long> of an array of paragraphs: their number, then the words of lanes."""

    def words(hashes: Column) -> list[Column]:
        put = lambda k: lambda acc, h: (acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_MODULO))
        return [F.aggregate(hashes, F.lit(0).cast("long"), put(k)) for k in range(_SPACING)]

    def hashed(p: Column, seed: int) -> Column:
        return F.transform(p, lambda x: F.xxhash64(F.lit(seed), x))

    def all_words(p: Column) -> Column:
        each = [let(hashed(p, seed), lambda h: F.array(*words(h))) for seed in SEEDS]
        return F.concat(F.array(F.size(p).cast("long")), *each)

    return let(parts, all_words)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or (sign -1) of ``a`` without ``b``."""
    count = lambda x, k: F.shiftrightunsigned(x, _SPACING * k).bitwiseAND(F.lit((1 << 20) - 1))
    lane = lambda x, y, k: F.pmod(count(x, k) + F.lit(sign) * count(y, k), F.lit(1 << 20))
    word = lambda x, y: lane(x, y, 0) + F.shiftleft(lane(x, y, 1), _SPACING) + F.shiftleft(lane(x, y, 2), 2 * _SPACING)
    n = F.array(a[0] + F.lit(sign) * b[0])
    return F.concat(n, F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(b, 2, F.size(b) - 1), word))


def signed_lanes(print_: Column) -> Column:
    """array<double>: the sum of signs in each lane, which is held modulo 2**21 once there are 2**20 paragraphs and read as the number nearest to 0."""
    count = lambda x, k: F.shiftrightunsigned(x, _SPACING * k).bitwiseAND(F.lit((1 << 20) - 1))
    lanes = F.flatten(F.transform(F.slice(print_, 2, F.size(print_) - 1), lambda x: F.array(*[count(x, k) for k in range(3)])))
    return F.transform(lanes, lambda c: (F.pmod(2 * c - print_[0] + F.lit(1 << 20), F.lit(1 << 21)) - F.lit(1 << 20)).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) as products of the signed lanes estimate it, from 0 to 1; exactly 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def of(x: Column, y: Column) -> Column:
        both = dot(x, x) + dot(y, y)
        return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(x, y) / both))).otherwise(F.lit(0.0))

    different = let(signed_lanes(a), lambda x: let(signed_lanes(b), lambda y: of(x, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(different)


def text_of(print_: Column) -> Column:
    """The fingerprint as a string: the number of paragraphs, and 16 hexadecimal digits a word."""
    return F.concat(F.lower(F.hex(print_[0])), F.lit("-"), F.lower(F.array_join(F.transform(F.slice(print_, 2, F.size(print_) - 1), lambda w: F.lpad(F.hex(w), 16, "0")), "")))


def place() -> Column:
    """What rows are sorted by, ascending, so that doc_ids fall and nulls come last.  The complement of an id falls as the id rises, and is never out of range."""
    id_ = F.col("doc_id").cast("long")
    return F.struct(id_.isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(id_), F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("digest"))


def limits(docs: DataFrame, bucket_rows: int, buckets: int) -> list[tuple[tuple[int, int, int], int]]:
    """Places of rows where buckets begin, ascending, each with the number of buckets that begin there.

    The first is the least place of all, the others stand at even distances in a sorted draw of rows: DRAWN for a
    bucket.  A place that is met more than once has so many rows of its own that they take several buckets.
    """
    n = docs.count()
    if not n:
        return []
    wanted = max(1, min(buckets, n // bucket_rows))
    least = docs.agg(F.min(place()).alias("p")).first()["p"]
    drawn = []
    if wanted > 1:
        rows = docs.sample(min(1.0, DRAWN * wanted / n), seed=7).select(place().alias("p"))
        # DRAWN * buckets places at most, on average, are numbered in one task, and one of DRAWN comes here
        rows = rows.withColumn("i", F.row_number().over(W.orderBy("p"))).where(F.col("i") % DRAWN == DRAWN // 2)
        drawn = [tuple(r["p"]) for r in rows.orderBy("p").select("p").collect()]
    found: dict[tuple, int] = {tuple(least): 1}
    for p in drawn:
        found[p] = found.get(p, 0) + 1
    return sorted(found.items())


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the document that follows in descending doc_id.

    Rows are sorted within buckets of neighbouring places, whose limits are places of rows (see limits()).  So the
    first row of a bucket is one that stands at its limit; it also goes, as a guest, to the end of the bucket
    before, and to the last bucket if it is the first of all.  Limits make one literal in the plan, which every
    row is found in by halving.

    Rows of one place are copies.  Where they take several buckets they are dealt by chance, to the last of which
    what follows them comes too; the last copy of each of the others is followed by a copy.  That none of the
    copies comes to one of these buckets, which would break the chain, has a chance of exp(-rows of a bucket).
    """
    found = limits(docs, bucket_rows, buckets)
    if not found:
        return docs.withColumn("next", F.when(F.lit(False), F.struct(*columns)))
    text = ",".join(f'{{"none":{p[0]},"id":{p[1]},"digest":{p[2]},"wide":{wide}}}' for p, wide in found)
    all_ = F.from_json(F.lit(f"[{text}]"), "array<struct<none:int,id:bigint,digest:bigint,wide:int>>")
    at = lambda k: F.get(all_, k)
    where = lambda x: F.struct(x["none"].alias("none"), x["id"].alias("id"), x["digest"].alias("digest"))
    n = len(found)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    halve = lambda k, step: F.when((k + step < n) & (where(at(k + step)) <= F.col("_at")), k + step).otherwise(k)
    rows = docs.withColumn("_at", place()).withColumn("_bucket", F.aggregate(steps, F.lit(0), halve))
    limit = at(F.col("_bucket"))
    rows = rows.withColumn("_wide", limit["wide"]).withColumn("_first", where(limit) == F.col("_at"))
    turn = F.when(F.col("_first") & (F.col("_wide") > 1), F.floor(F.rand(11) * F.col("_wide")).cast("int")).otherwise(F.col("_wide") - 1)
    rows = rows.withColumn("_turn", turn)
    stay = F.struct(F.col("_bucket").alias("bucket"), F.col("_turn").alias("turn"), F.lit(0).alias("guest"))
    host = F.pmod(F.col("_bucket") - 1, F.lit(n))
    visit = F.struct(host.alias("bucket"), (at(host)["wide"] - 1).alias("turn"), F.lit(1).alias("guest"))
    rows = rows.withColumn("_place", F.explode(F.when(F.col("_first") & (F.col("_turn") == 0), F.array(stay, visit)).otherwise(F.array(stay))))
    within = W.partitionBy("_place.bucket", "_place.turn").orderBy("_place.guest", "_at")
    follower = F.coalesce(F.lead(F.struct(*columns)).over(within), F.struct(*columns))
    rows = rows.withColumn("next", follower).where("_place.guest = 0")
    return rows.drop("_at", "_bucket", "_wide", "_first", "_turn", "_place")


def op2_homomorphic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    docs = docs.withColumn("print", fingerprint(paragraphs(F.col("text"))))
    rows = with_next(docs, ["text", "print"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    rows = rows.withColumn("edited_print", fingerprint(paragraphs(F.col("edited"))))
    return rows.select(
        "doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"),
        text_of(F.col("print")).alias("fingerprint"), text_of(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
