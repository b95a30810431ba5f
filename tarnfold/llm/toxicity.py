"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (with its limits marked), so a misspelling
or an unseen form shares most of a known word's vectors.  A linear softmax over two classes scores it.  A
document's bag is the average over its distinct words, weighted by a softmax of their own scores: even
weights at the start of training, then ever more on the words that speak for the class, so that a few
words count alike in a short and in a long text.

Only the fitting is bounded: by ``SAMPLE`` documents labelled toxic and three times as many others, the
first by a hash of doc_id; of several rows with one doc_id, one bag of words stands for it, the least.
The vectors of n-grams then become one number per n-gram (the softmax is linear), and whole texts are
scored with them on the executors.

Defined results: null and empty texts get the score of a bag without words; a very long text is scored as a
whole; repeated rows and ties of doc_id get the scores of their own texts; without labels of both classes every score is the share of toxic labels (0 without any); repeated
labels of a doc_id count as toxic if one does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out_mod, table, whole_text
from .shingles import scramble
from .words import batches

SAMPLE = 1500
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 60
DAMPING = 100.0
DECAY = 0.003
SHARPEST = 6.0
#: Words whose scores a worker keeps.
KEEP = 500_000


def distinct_words(text: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return sorted({w.strip(".,;:!?\"'()[]|#*$%&<>-") for w in text.lower().split()} - {""})


def gram_ids(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of ``<word>``, as flat arrays, words ascending."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    whose, which = [], []
    for n in GRAMS:
        start = at[at + n <= ends]
        mixed = np.full(len(start), n, np.uint64)
        for i in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + codes[start + i]
        whose.append(owner[start])
        which.append((scramble(mixed) % np.uint64(buckets)).astype(np.int64))
    whose, which = np.concatenate(whose), np.concatenate(which)
    order = np.argsort(whose, kind="stable")
    return whose[order], which[order]


class Model:
    """``gram``: what each n-gram says for the class; a word's score is their average.  A bag without words scores ``empty``."""

    def __init__(self, gram: np.ndarray, scale: float, shift: float, empty: float):
        self.gram, self.scale, self.shift, self.empty = gram, scale, shift, empty

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        whose, which = gram_ids(words, len(self.gram))
        n = np.bincount(whose, minlength=len(words))
        return np.bincount(whose, self.gram[which], len(words)) / np.maximum(n, 1)

    def score(self, z: np.ndarray) -> float:
        if not len(z):
            return self.empty
        w = np.exp(SHARPEST * (z - z.max()))
        return float(1 / (1 + np.exp(-np.clip(self.scale * (w @ z) / w.sum() + self.shift, -30, 30))))


def fit(texts: list[list[str]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """From the distinct words of each document and its label."""
    y = labels.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), share)
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n_docs, n_words = len(texts), len(vocabulary)
    whose, which = gram_ids(list(vocabulary))
    n_grams = np.maximum(np.bincount(whose, minlength=n_words), 1)
    rng = np.random.default_rng(seed)
    vector = np.zeros((BUCKETS, DIM))  # n-grams that no training text has say nothing
    softmax = rng.normal(0, 0.5, (DIM, 2))
    bias = -2.0
    # steps of n-grams that few texts have stay small, so that no text is learnt by its rare words
    seen_v, seen_s, seen_b = np.full((BUCKETS, 1), DAMPING), np.full((DIM, 2), 1e-2), 1e-2
    weight = np.where(y == 1, ((1 - y).sum() / y.sum()) ** 0.5, 1.0)
    weight *= n_docs / weight.sum()
    length = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    for epoch in range(epochs):
        sharp = SHARPEST * min(1.0, epoch / (0.6 * epochs))
        direction = softmax[:, 1] - softmax[:, 0]
        z = np.bincount(whose, (vector @ direction)[which], n_words) / n_grams
        zd = z[word]
        top = np.full(n_docs, -np.inf)
        np.maximum.at(top, doc, zd)
        a = np.exp(sharp * (zd - top[doc]))
        a /= np.maximum(np.bincount(doc, a, n_docs), 1e-300)[doc]
        logit = np.bincount(doc, a * zd, n_docs) * 4 + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g = weight * (p - y) * (length > 0)
        per_word = np.bincount(word, 4 * a * g[doc], n_words) / n_grams
        per_gram = np.bincount(which, per_word[whose], BUCKETS)
        grad_v = per_gram[:, None] * direction[None, :]
        grad_d = per_gram @ vector
        grad_s = np.stack([-grad_d, grad_d], 1)
        seen_v += (grad_v**2).sum(1, keepdims=True)
        seen_s += grad_s**2
        seen_b += float(g.sum()) ** 2
        vector -= 0.25 * grad_v / np.sqrt(seen_v) + DECAY * vector
        softmax -= 0.1 * grad_s / np.sqrt(seen_s)
        bias -= 0.25 * float(g.sum()) / np.sqrt(seen_b)
    model = Model(vector @ (softmax[:, 1] - softmax[:, 0]), 4.0, bias, 0.0)
    model.empty = float(1 / (1 + np.exp(-np.clip(bias - 4 * SHARPEST, -30, 30))))
    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list[list[str]], np.ndarray]:
    """Distinct words and labels of training documents: up to ``per_class`` toxic ones, and three times as many others."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out_mod(5, 0)).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.where(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((0, 3 * per_class), (1, per_class))]
    chosen = chosen[0].unionByName(chosen[1])

    def words(rows):
        import pyarrow as pa

        for batch in batches(rows):
            joined = [" ".join(distinct_words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(joined, pa.string())], ["doc_id", "toxic", "words"])

    both = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 4 * per_class rows of two numbers
    rows = both.mapInArrow(words, "doc_id long, toxic int, words string")
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("words").alias("words")).orderBy("doc_id").toArrow()  # at most 4 * per_class rows
    return [w.split(" ") if w else [] for w in rows.column("words").to_pylist()], rows.column("toxic").to_numpy()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def score(rows):
        import pyarrow as pa

        model, known = shared.value, {}
        for batch in batches(rows):
            texts = [distinct_words(t) for t in batch.column("text").to_pylist()]
            missing = sorted({w for t in texts for w in t if w not in known})
            if len(known) > KEEP:
                known.clear()
                missing = sorted({w for t in texts for w in t})
            for i in range(0, len(missing), 20_000):
                part = missing[i : i + 20_000]
                known.update(zip(part, model.word_scores(part).tolist()))
            scores = [model.score(np.fromiter(map(known.__getitem__, t), np.float64, len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(score, "doc_id long, score double")


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sample(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out_mod(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
