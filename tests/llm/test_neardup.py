import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import neardup
from tarnfold.llm.common import stored
from tarnfold.llm.components import components


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """The least doc_id of each text's class."""
    texts = list(dict.fromkeys(t for _, t in rows))
    sets = {t: shingles(t) for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    where, empty = collections.defaultdict(list), None
    for t in texts:
        shared = collections.Counter(u for s in sets[t] for u in where[s])
        for u, n in shared.items():
            if n >= 0.8 * (len(sets[t]) + len(sets[u]) - n) - 1e-9:
                parent[root(t)] = root(u)
        for s in sets[t]:
            where[s].append(t)
    least = {}
    for i, t in rows:
        least[root(t)] = min(x for x in (least.get(root(t)), i) if x is not None) if (least.get(root(t)), i) != (None, None) else None
    return {t: least[root(t)] for t in texts}, empty


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_classes_against_brute_force(spark, request, which):
    path = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = neardup.classes(docs.select("doc_id", "text")).select("doc_id", "node", "class_id").distinct()
    nodes = docs.select(F.unhex(F.md5("text")).alias("node"), "text").distinct()
    found = got.join(nodes, "node").select("text", "class_id").distinct().collect()
    blank = {r.text for r in found if not r.text.strip()}  # texts without a word have no shingle: each is a class
    assert all(r.class_id in (want[r.text],) or r.class_id < 0 for r in found if r.text not in blank)
    assert len(found) == nodes.count()


def test_signature_agreement_is_probability_jaccard():
    rng = np.random.default_rng(2)
    for a, b in ((200, 40), (30, 30), (3, 2)):
        both = rng.integers(1, 2**62, a).astype(np.uint64)
        x, y = (np.concatenate((both, rng.integers(1, 2**62, b).astype(np.uint64))) for _ in range(2))
        agree = []
        for seed in range(40):
            turn = np.uint64(rng.integers(1, 2**62))
            doc = np.repeat([0, 1], [len(x), len(y)])
            sig = neardup.signatures(doc, np.concatenate((x, y)) ^ turn, np.ones(len(x) + len(y)), 2, 252)
            assert (sig != 0).all()
            agree.append((sig[0] == sig[1]).mean())
        assert np.mean(agree) == pytest.approx(a / (a + 2 * b), abs=0.04)


def test_weights_count():
    """Of two shingles, one four times as heavy takes four fifths of the registers."""
    rng = np.random.default_rng(3)
    share = []
    for _ in range(200):
        s = rng.integers(1, 2**62, 2).astype(np.uint64)
        share.append((neardup.signatures(np.zeros(2, np.int64), s, np.array([4.0, 1.0]), 1, 252)[0] == s[0]).mean())
    assert np.mean(share) == pytest.approx(0.8, abs=0.02)


def test_near_copies_are_found_whatever_repeats(spark):
    """Pairs with a similarity just above 0.8, of which one text says the rest of its shingles 20 times."""
    rows = []
    for k in range(40):
        once, often = ([f"{c}{k}x{i}" for i in range(n)] for c, n in (("a", 104), ("b", 20)))
        rows += [(2 * k, " ".join(once)), (2 * k + 1, " ".join(once + often * 20))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(80)}


def test_unit_links_join_what_belongs_together():
    rng = np.random.default_rng(1)
    for trial in range(20):
        base, sets = np.sort(rng.choice(10**6, 60, replace=False)).astype(np.uint64), []
        for _ in range(70):
            s, k = base.copy(), rng.integers(0, 14)
            s[rng.choice(60, k, replace=False)] = rng.integers(10**7, 10**8, k)
            sets.append(np.unique(s))
        side = rng.integers(0, 2, 70) if trial % 2 else np.zeros(70, np.int64)

        def joined(pairs):
            group = list(range(70))
            for i, j in pairs:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
            return group

        similar = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        want = [(i, j) for i in range(70) for j in range(i) if (side[i] != side[j] or not side.any()) and similar(sets[i], sets[j])]
        assert joined(want) == joined(neardup.unit_links(sets, side))


def test_a_unit_of_one_side_has_no_links():
    sets = [np.arange(9, dtype=np.uint64)] * 3
    assert neardup.unit_links(sets, np.ones(3, np.int64)) == []


def test_large_clusters_meet_in_blocks(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted(neardup.op3_probminhash_near_duplicates(spark, sf).collect())
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 2)
    assert sorted(neardup.classes(docs).select("doc_id", "class_id", "representative").collect()) == want


@pytest.mark.parametrize("texts_in_block", [4, 12])
def test_large_clusters_of_several_classes_lose_no_link(spark, monkeypatch, texts_in_block):
    """Drifting copies: neighbours are similar, far ones aren't, and clusters hold several classes; held against all pairs."""
    rng = np.random.default_rng(7)
    rows = []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(80)]
        for k in range(45):
            for at in rng.choice(80, rng.integers(1, 4), replace=False):
                words[at] = f"f{family}n{k}x{at}"
            rows.append((1000 * family + k, " ".join(words)))
    rows += [(9000 + i, rows[i][1]) for i in range(0, 40, 7)]
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", texts_in_block)
    want, _ = brute(rows)
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: want[t] for i, t in rows}
    assert 20 < len(set(want.values())) < 150


def test_a_large_class_meets_its_hub_only(spark, monkeypatch):
    """After the first pass nothing is left to meet, however many blocks the texts make."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 10)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = stored(neardup.signed(docs), "signed")
    members, edges = neardup.clusters(found)
    large = neardup.dealt(members).where("large")
    units = neardup.by_hub(large.select("node", "n", "cluster"), edges)
    assert large.count() == 200 and 200 <= units.count() < 260
    roots = components(neardup.verified(stored(units, "units"), docs))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    assert neardup.across(large.select("node", "n", "cluster"), roots).count() == 0
    assert {r.class_id for r in neardup.classes(docs).collect()} == {0}


def test_components(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("e", "d"), ("f", "a"), ("z", "z")]
    rows = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.node: r.root for r in rows} == {"b": "a", "c": "a", "d": "a", "e": "a", "f": "a", "y": "x"}
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    assert {r.root for r in components(spark.createDataFrame(chain, "a string, b string")).collect()} == {"000"}


def test_one_of_each(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text").collect()
    assert len(rows) == neardup.classes(docs.select("doc_id", "text")).select("class_id").distinct().count()
    kept = {r.doc_id for r in rows}
    assert 0 in kept and 3 in kept and not kept & {1, 2, 18}
