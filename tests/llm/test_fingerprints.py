import bisect
import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from tarnfold.llm import fingerprints as fp


def parts(t):
    return sorted(re.split(r"\n|(?<=[.!?]) ", t))


def brute(docs):
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in fp.op2_homomorphic_fingerprints(spark, sf).collect()}
    prints = {}
    dice = lambda a, b: 2 * sum(n * b[p] for p, n in a.items()) / sum(n * n for c in (a, b) for n in c.values())
    errors = []
    for i, t, edited, after in brute(docs):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for text, found in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(tuple(parts(text)), found) == found
        a, b, c = (collections.Counter(parts(x)) for x in (t, edited, after))
        errors += [abs(r.near_edited - dice(a, b)), abs(r.near_next - dice(a, c))]
    assert len(set(prints.values())) == len(prints)
    assert sum(errors) / len(errors) < 0.1 and sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())


def test_order_insertion_and_deletion(spark):
    rows = [("one\ntwo\nthree", "three\none\ntwo", "one\ntwo", "three"), ("a\na\nb", "b\na\na", "a\nb", "a")]
    df = spark.createDataFrame(rows, "whole string, turned string, rest string, extra string")
    of = lambda c: fp.fingerprint(fp.paragraphs(F.col(c)))
    out = df.select(of("whole").alias("w"), of("turned").alias("t"), of("rest").alias("r"), of("extra").alias("e"))
    out = out.select("w", "t", "r", fp.combined(F.col("r"), F.col("e")).alias("sum"), fp.combined(F.col("w"), F.col("e"), -1).alias("difference"))
    for r in out.collect():
        assert r.w == r.t == r["sum"] and r.difference == r.r != r.w


def test_next_document_across_buckets(spark):
    ids = [None, None, 5, 5, 7, 1000, -3, 10**12, 44]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.text: r.next.text for r in fp.with_next(df, ["text"], bucket_rows=1).collect()}
    assert sorted(got) == sorted(got.values()) and len(got) == len(ids)
    by_text = {f"t{k}": i for k, i in enumerate(ids)}
    at = max(by_text, key=lambda t: -float("inf") if by_text[t] is None else by_text[t])
    seen = []
    for _ in ids:  # one round through all documents, ids falling, nulls last
        seen.append(by_text[at])
        at = got[at]
    assert seen == [10**12, 1000, 44, 7, 5, 5, -3, None, None]


def chain(spark, ids, texts, **how):
    """The pairs (own, next) of (doc_id, text), and those that a sort of all rows gives."""
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = collections.Counter(((r.doc_id, r.text), (r.next.doc_id, r.next.text)) for r in fp.with_next(df, ["doc_id", "text"], **how).collect())
    digest = {r.text: r.d for r in df.select("text", F.xxhash64("text").alias("d")).distinct().collect()}
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is None, -(r[0] or 0), digest[r[1]]))
    return got, collections.Counter(zip(rows, rows[1:] + rows[:1]))


def test_next_document_with_ids_of_any_width(spark):
    dice = random.Random(3)
    wide = [dice.randint(-(2**63), 2**63 - 1) for _ in range(2000)] + [-(2**63), 2**63 - 1, 0, -1]
    narrow = [*range(2000), 10**15, -(10**18)]
    same = [77] * 2000 + [None] * 1500
    for ids in (wide, narrow, same):
        texts = [f"t{dice.randint(0, 10**6)}" for _ in ids]
        got, want = chain(spark, ids, texts, bucket_rows=100)
        assert got == want


def test_copies_of_one_document_follow_each_other(spark):
    ids = [5] * 3000 + [None] * 2000 + list(range(1000))
    texts = ["copy"] * 3000 + [""] * 2000 + [f"t{i % 7}" for i in range(1000)]
    got, want = chain(spark, ids, texts, bucket_rows=100)
    assert got == want


def test_buckets_are_even_whatever_the_ids_are(spark):
    dice = random.Random(8)
    for ids in ([*range(20_000), 10**15], [dice.randint(-(2**63), 2**63 - 1) for _ in range(20_000)], [None] * 20_000):
        df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
        places = sorted(tuple(r.p) for r in df.select(fp.place().alias("p")).collect())
        starts = [p for p, _ in fp.limits(df, 200, 1000)]
        at = [bisect.bisect_left(places, p) for p in starts] + [len(places)]
        sizes = sorted(b - a for a, b in zip(at, at[1:]))
        assert len(sizes) > 80 and sizes[-1] <= 2.2 * sizes[len(sizes) // 2]


def test_lanes_hold_beyond_their_modulus(spark):
    """2**20 paragraphs and more: equal parts still count as equal, others don't."""
    n = (1 << 20) + 50_000
    many = lambda mark: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(mark), i.cast("string")))
    df = spark.range(1).select(many("c").alias("c"), many("d").alias("d"))
    prints = df.select(*[fp.fingerprint(F.col(c)).alias(c) for c in "cd"], fp.fingerprint(F.concat("c", F.slice("d", 1, 1000))).alias("e"))
    row = prints.select(fp.likeness(F.col("c"), F.col("d")).alias("cd"), fp.likeness(F.col("c"), F.col("e")).alias("ce"), fp.likeness(F.col("c"), F.col("c")).alias("cc")).first()
    assert row.cc == 1 and row.ce > 0.9 and row.cd < 0.4
