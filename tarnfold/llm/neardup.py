"""Near duplicates by ProbMinHash signatures, banding and verification.

Texts are sets of five-word shingles; however often a shingle stands in a text, its weight is 1, so that
signatures agree as links are defined.  Each shingle is a Poisson process whose arrivals land in the
registers of a signature, each register once per shingle; a register keeps the shingle that came first.
Two signatures agree in a register with the probability Jaccard similarity of the sets, which is the plain
one at equal weights.  Arrivals stop once they are later than everything that the registers hold.

Texts that agree in a band of registers are candidates.  Candidates that hang together make a cluster,
and within a cluster every two texts are held against each other: links are those whose sets of shingles,
taken from the whole texts, have a Jaccard similarity of at least 0.8.  Overlaps are counted shingle by
shingle, so no pair becomes a row, and a link is passed on only if it joins what earlier ones left apart.
Classes are the connected components of the links.  Equal texts are one node, found by digest, so copies never meet.

A cluster that is too large for one task is verified in two passes.  In the first each text meets the hub that it
shares most bands with, beside others of that hub; what is linked there is one class already, and two texts of
a class need not meet again.  In the second what is left apart meets: blocks of texts, each two of which come
together in a task of bounded size, but for those of one class.

Defined results: null and empty texts are one class of equal (empty) texts; a text of one to four words
is one shingle; a very long text is taken as a whole; repeated rows fall into one class; a class is named by its least doc_id that isn't null
(by a negative number from its digest if all are null, or if that doc_id names another class); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored, table, whole_text
from .components import components
from .shingles import Powers, scramble, shingle_counts, word_hashes
from .words import batches

SIMILARITY = 0.8
#: Registers in a band and bands: of pairs with 0.8, all but 3 in a million agree in a band.
ROWS, BANDS = 6, 42
#: A block of a large cluster has about so many shingles at most, and so many texts.
BLOCK_SHINGLES, BLOCK_TEXTS = 1_000_000, 3000


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs, m) of weighted sets given as flat arrays, ``doc`` ascending."""
    first = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    seed = scramble(shingle ^ np.uint64(0x51ED270B))
    walk = (seed % np.uint64(m)).astype(np.int64)
    # a step that is coprime to m visits every register once
    coprime = np.array([s for s in range(1, m) if np.gcd(s, m) == 1])
    step = coprime[((seed >> np.uint64(32)) % np.uint64(len(coprime))).astype(np.int64)]
    time = np.zeros(len(shingle))
    alive = np.arange(len(shingle))
    for r in range(m):
        if not len(alive):
            break
        dice = scramble(seed[alive] + np.uint64((r + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        u = ((dice >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[alive] -= np.log(u) / weight[alive] * (m / (m - r))
        cell = doc[alive] * m + (walk[alive] + r * step[alive]) % m
        t = time[alive]
        better = np.flatnonzero(t < first[cell])
        if len(better):
            cells, times, who = cell[better], t[better], alive[better]
            order = np.lexsort((times, cells))
            cells = cells[order]
            head = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            first[cells[head]] = times[order][head]
            held[cells[head]] = shingle[who[order][head]]
        docs, back = np.unique(doc[alive], return_inverse=True)
        latest = first.reshape(n_docs, m)[docs].max(axis=1)
        alive = alive[t < latest[back]]
    return held.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """(n_docs, bands) of 64-bit keys; equal keys mean equal registers in the same band."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    parts = sig[:, : rows * bands].reshape(len(sig), bands, rows)
    for i in range(rows):
        keys = scramble(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_shingles, bands) for (doc_id, text); node is the text's digest."""

    def sign(rows):
        import pyarrow as pa

        powers = Powers()
        for batch in batches(rows):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            words, at = word_hashes(texts, powers)
            sets = [shingle_counts(words[a:b]) for a, b in zip(at[:-1], at[1:])]
            sizes = np.array([len(s) for s, _ in sets])
            doc = np.repeat(np.arange(len(texts)), sizes)
            sig = signatures(doc, np.concatenate([s for s, _ in sets]), np.ones(len(doc)), len(texts), ROWS * BANDS)
            keys = band_keys(sig).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(sizes.astype(np.int64)), lists], ["doc_id", "node", "n_shingles", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(whole_text())).alias("node"), whole_text().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, node binary, n_shingles long, bands array<long>")


def clusters(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, cluster) for every node that shares a band, and (a, b, bands): with which hub it shares how many.

    ``found`` is the stored output of signed(); a band's hub is its least node.
    """
    nodes = found.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).where("n > 0")
    bands = stored(nodes.select("node", "n", F.explode("bands").alias("band")), "bands")
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = stored(hubs.select("band", "hub"), "hubs")  # a join of plain shuffles, which Spark can split where a band is hot
    edges = bands.join(hubs.hint("merge"), "band").where(F.col("node") != F.col("hub")).groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("bands"))
    edges = stored(edges, "edges")
    roots = components(edges)
    sizes = nodes.select("node", "n")
    own = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = own.join(sizes, "node").select("node", "n", F.col("root").alias("cluster"))
    return stored(members, "clusters"), edges


def _blocks(shingles: str, texts: str):
    return F.greatest(F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.ceil(F.col(texts) / BLOCK_TEXTS))


def dealt(members: DataFrame) -> DataFrame:
    """(node, unit, side, large) from clusters(): a unit for each cluster that is small enough; of ``large`` ones the nodes alone, without a unit."""
    total = members.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    total = stored(total.select("cluster", (_blocks("shingles", "texts") > 1).alias("large")), "sizes")
    rows = members.join(total, "cluster")
    return rows.select("node", F.when(~F.col("large"), F.xxhash64("cluster")).alias("unit"), F.lit(0).alias("side"), "large", "n", "cluster")


def by_hub(large: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, unit, side): each node of large clusters beside the hub that it shares most bands with; many such nodes are dealt to several units, each with the hub."""
    best = F.min_by(F.col("b"), F.struct(-F.col("bands"), "b"))
    chosen = edges.groupBy(F.col("a").alias("node")).agg(best.alias("hub")).join(large.select("node", "n"), "node")
    total = chosen.groupBy("hub").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    total = stored(total.select("hub", _blocks("shingles", "texts").alias("parts")), "hub-sizes")
    unit = lambda part: F.xxhash64("hub", part, F.lit("hub"))
    nodes = chosen.join(total.hint("merge"), "hub").select("node", unit(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("unit"))
    hubs = total.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("hub").alias("node"), unit(F.col("part")).alias("unit"))
    return nodes.unionByName(hubs).withColumn("side", F.lit(0))


def across(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, unit, side): the meetings of large clusters' nodes that are in different classes so far.

    Blocks hold texts of one class, or of several small ones, and each two meet, but for two of one class; a block of
    several classes also meets itself.
    """
    rows = large.select("node", "n", "cluster").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    own = rows.groupBy("cluster", "class").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    own = own.withColumn("parts", F.when((F.col("shingles") >= BLOCK_SHINGLES / 2) | (F.col("texts") >= BLOCK_TEXTS / 2), _blocks("shingles", "texts")).otherwise(0))
    small = F.sum(F.when(F.col("parts") == 0, F.col("shingles"))), F.sum(F.when(F.col("parts") == 0, F.col("texts")))
    total = own.groupBy("cluster").agg(F.count("*").alias("classes"), F.coalesce(small[0], F.lit(0)).alias("shingles"), F.coalesce(small[1], F.lit(0)).alias("texts"))
    total = total.where("classes > 1").select("cluster", _blocks("shingles", "texts").alias("shared"))
    own = stored(own.select("cluster", "class", "parts").join(total, "cluster"), "class-sizes")

    def blocks(rows):  # a block is told by its class (empty for one of several) and its number
        return rows.withColumn("label", F.when(F.col("parts") > 0, F.col("class")).otherwise(F.lit(b"")))

    all_ = blocks(own).groupBy("cluster", "label").agg(F.max(F.when(F.col("parts") > 0, F.col("parts")).otherwise(F.col("shared"))).alias("parts"))
    all_ = all_.select("cluster", F.col("label").alias("other_label"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = blocks(rows.join(own.hint("merge"), ["cluster", "class"]))
    number = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("class"), F.col("shared")))
    rows = rows.select("node", "cluster", "label", number.alias("block")).join(stored(all_, "blocks"), "cluster")
    one, two = F.struct("label", "block"), F.struct(F.col("other_label").alias("label"), F.col("other").alias("block"))
    rows = rows.where((F.col("label") != F.col("other_label")) | (F.octet_length("label") == 0))
    unit = F.xxhash64("cluster", F.least(one, two), F.greatest(one, two))
    return rows.select("node", unit.alias("unit"), F.when(one <= two, 0).otherwise(1).alias("side"))


def unit_links(sets: list[np.ndarray], side: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the texts of a unit, as pairs of positions; if there are two sides, one text is of either."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    at = np.zeros(n, np.int64)  # the place among its own side
    at[left] = np.arange(len(left))
    at[right] = np.arange(len(right))
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])[order]
    cuts = np.flatnonzero(np.concatenate(([True], shingle[order][1:] != shingle[order][:-1], [True])))
    spread = np.diff(cuts)
    common = np.zeros((len(left), len(right)), np.float32)
    frequent = np.flatnonzero(spread > 24)
    for k in range(0, len(frequent), 1024):
        some = frequent[k : k + 1024]
        has = np.zeros((n, len(some)), np.float32)
        for c, f in enumerate(some):
            has[owner[cuts[f] : cuts[f + 1]], c] = 1
        common += has[left] @ has[right].T
    for f in np.flatnonzero((spread > 1) & (spread <= 24)):
        who = owner[cuts[f] : cuts[f + 1]]
        a, b = (who[side[who] == 0], who[side[who] == 1]) if side.any() else (who, who)
        if len(a) and len(b):
            common[np.ix_(at[a], at[b])] += 1
    none = np.zeros(0, np.int64)
    found = [(none, none)]  # one side may be missing
    for k in range(0, len(left), 256):  # a stripe at a time, as the comparison takes several times the table's memory
        some = slice(k, k + 256)
        i, j = np.nonzero((1 + similarity) * common[some].astype(np.float64) + 1e-6 >= similarity * (sizes[left[some]][:, None] + sizes[right][None, :]))
        found.append((left[some][i], right[j]))
    x, y = (np.concatenate(z) for z in zip(*found))
    keep = (x != y) if side.any() else (x < y)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x[keep].tolist(), y[keep].tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def links(found: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes that make up the classes, from ``docs`` (text)."""
    members, edges = clusters(found)
    units = stored(dealt(members), "units")
    large = units.where("large").select("node", "n", "cluster")
    if large.isEmpty():
        return verified(units.select("node", "unit", "side"), docs, similarity)
    first = units.where(~F.col("large")).select("node", "unit", "side").unionByName(by_hub(large, edges))
    first = verified(stored(first, "units"), docs, similarity)
    roots = components(first)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    left = stored(across(large, roots), "units")
    return first if left.isEmpty() else first.unionByName(verified(left, docs, similarity))


def verified(units: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links within units (node, unit, side), from ``docs`` (text)."""
    # texts are shuffled by node once, copies dropped before (a semi-join would be pushed below that), and by unit once
    texts = docs.select(F.unhex(F.md5(whole_text())).alias("node"), whole_text().alias("text"))
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    rows = texts.join(units.hint("merge"), "node").repartition("unit").sortWithinPartitions("unit")

    def hold(batches_):
        import pyarrow as pa

        powers = Powers()
        unit, nodes, sets, side = None, [], [], []

        def done():
            pairs = unit_links(sets, np.array(side), similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches(batches_):
            words, at = word_hashes([t.encode() for t in batch.column("text").to_pylist()], powers)
            for u, node, s, p, q in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), batch.column("side").to_pylist(), at[:-1], at[1:]):
                if u != unit:
                    yield done()
                    unit, nodes, sets, side = u, [], [], []
                nodes.append(node)
                sets.append(shingle_counts(words[p:q])[0])
                side.append(s)
        yield done()

    return stored(rows.select("unit", "node", "side", "text").mapInArrow(hold, "a binary, b binary"), "links")


def named(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Per node: root, class_id, and the representative of its class (``head_node``, ``head_doc``)."""
    copies = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    copies = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = copies.groupBy("root").agg(F.min_by(F.struct("least", "node"), F.struct(F.col("least").isNull(), "least", "node")).alias("head"))
    own = -F.abs(F.shiftright(F.xxhash64("root"), 1)) - 1
    heads = heads.withColumn("class_id", F.coalesce(F.col("head.least"), own))
    heads = heads.withColumn("class_id", F.when(F.row_number().over(W.partitionBy("class_id").orderBy("root")) == 1, F.col("class_id")).otherwise(own))
    out = copies.join(heads, "root").select("node", "root", "class_id", F.col("head.node").alias("head_node"), F.col("head.least").alias("head_doc"))
    return stored(out, "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id, representative) per row; the representative's exact copies of one doc_id all carry the mark."""
    found = stored(signed(docs), "signed")
    with scratch() as keep:
        names = keep(named(found, components(links(found, docs, similarity))))
    mark = (F.col("head_node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("head_doc"))
    return found.select("doc_id", "node").join(names, "node").select("doc_id", "node", "class_id", mark.alias("representative"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``docs`` (doc_id, text and others): of the representative's exact copies, any one."""
    narrow = docs.select("doc_id", "text")
    with scratch() as keep:
        found = stored(signed(narrow), "signed")
        names = keep(named(found, components(links(found, narrow, similarity))))
    heads = names.where("node = head_node").select("node", "head_doc")
    # copies are told apart by doc_id before they meet, and of rows that agree in that too one is left before the last shuffle
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.unhex(F.md5(whole_text())).alias("node"), F.col("doc_id").cast("long").alias("id"))
    same = (rows["node"] == heads["node"]) & F.col("id").eqNullSafe(F.col("head_doc"))
    rows = rows.join(heads.hint("merge"), same).select(rows["node"], "doc")
    return rows.groupBy("node").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")


def op3_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "representative")


#: The same in DuckDB, by counting shared shingles of all pairs and following links; for documents with unique ids and at least a word.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * shared >= {round(10 * SIMILARITY)} * (x.n + y.n - shared)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id),
m AS (SELECT doc_id, min(r) AS class_id FROM c GROUP BY doc_id)
SELECT doc_id, class_id, doc_id = class_id AS representative FROM m"""
