import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import toxicity


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op5_subword_toxicity(spark, path).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > 0.88


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(300)]
    texts = [sorted(set(rng.choice(vocabulary, 40)) | ({"wretched"} if i % 4 == 0 else set())) for i in range(200)]
    model = toxicity.fit(texts, np.array([int(i % 4 == 0) for i in range(200)]))
    known, misspelt, other = model.word_scores(["wretched", "wretchedd", vocabulary[0]])
    assert known > misspelt > other
    assert model.score(model.word_scores(["wretchedd", *vocabulary[:30]])) > model.score(model.word_scores(vocabulary[:30]))


@pytest.mark.parametrize("toxic,share", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_without_labels_of_both_classes_scores_are_the_share(toxic, share):
    model = toxicity.fit([["a", "b"]] * len(toxic), np.array(toxic))
    for words in ([], ["a", "new"]):
        assert model.score(model.word_scores(words)) == pytest.approx(share, abs=1e-6)


def test_labels_of_held_out_rows_are_never_read(spark, odd, tmp_path):
    """Turning their labels changes no score."""
    docs, labels = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(str, toxicity.scored(docs, toxicity.fit(*toxicity.sample(docs, x))).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_scores_against_brute_force(spark, odd):
    """Every score from the model's n-grams, word by word and document by document, in plain Python."""
    import math

    docs, labels = (spark.read.parquet(f"{odd}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("labels", ["doc_id", "toxic"])))
    model = toxicity.fit(*toxicity.sample(docs, labels))

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor % 2**64
        return (h ^ (h >> 31)) % toxicity.BUCKETS

    def word(w):
        w = f"<{w}>"
        grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
        return sum(model.gram[bucket(g)] for g in grams) / max(1, len(grams))

    def score(text):
        bag = {w.strip(".,;:!?\"'()[]|#*$%&<>-") for w in text.lower().split()} - {""}
        if not bag:
            return model.empty
        z = [word(w) for w in bag]
        top = max(z)
        weights = [math.exp(toxicity.SHARPEST * (x - top)) for x in z]
        mean = sum(a * x for a, x in zip(weights, z)) / sum(weights)
        return 1 / (1 + math.exp(-max(-30, min(30, model.scale * mean + model.shift))))

    rows = [(r.doc_id, r.text or "") for r in docs.collect() if len(r.text or "") < 60_000]
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in toxicity.scored(docs.where("coalesce(length(text), 0) < 60000"), model).collect())
    want = sorted((str(i), round(score(t), 6)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_many_rows_of_a_labelled_document_are_one_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "b a")] * 500 + [(1, "c"), (2, "d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    kept = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    words, toxic = toxicity.sample(docs, labels)
    assert len(words) == len(kept) == len(toxic) and (1 not in kept or ["a", "b"] in words)
