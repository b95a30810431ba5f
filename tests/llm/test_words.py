import random

import pytest
from tokenizers import Tokenizer

from tarnfold.llm.counting import CountedText, SegmentTree, counted
from tarnfold.llm.words import Encoder, tokenizer_path

ODD = ["", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a  b", " x y", "a\r\nb", "it's\nwe'll ok", " ", "\n", "é a", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>", "x  <|endoftext|>  y\n\n<|endoftext|>\nz", "<|endoftext|><|endoftext|>", "<|endoftext", "a \n<|endoftext|> b c", "a \nb", "日本 語\n\t x", "a\xa0b \xa0c", "\x1c a \x85"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokenizer_path())
    
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_ids_are_the_tokenizers(texts, reference):
    encoder = Encoder(tokenizer_path())
    for _ in range(2):  # with and without kept pieces
        assert [x.tolist() for x in encoder.batch(texts + ODD)] == [reference(t) for t in texts + ODD]


def test_random_white_space(reference):
    dice, encoder = random.Random(5), Encoder(tokenizer_path())
    made = ["".join(dice.choice(["a", "Bc", " ", " ", "\n", "\t", "'s", ".", "é", "\xa0", "7", "  ", "ß", "²", "日", "я", "\u2028", "<|endoftext|>"]) for _ in range(dice.randint(0, 30))) for _ in range(2000)]
    assert [x.tolist() for x in encoder.batch(made)] == [reference(t) for t in made]


def test_edits_keep_counts_exact(texts, reference):
    dice, encoder = random.Random(3), Encoder(tokenizer_path())
    news = ["", " ", "\n", "x", "<|endoftext|>", "<|endof", "text|>", "  <|endoftext|> ", " word", " word ", "Wort und", "\n\n", "é", " a\nb", "don't ", "\xa0"]
    for t in texts[:40] + ODD:
        t = t[:2000]
        doc = CountedText(t, encoder)
        for _ in range(25):
            a = dice.randint(0, len(t))
            b = min(len(t), a + dice.choice([0, 0, 1, 3, 20]))
            new = dice.choice(news)
            doc.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert doc.text() == t and doc.count() == len(reference(t)), (t, a, b, new)


def test_an_edit_encodes_a_few_pieces_only(texts):
    doc = CountedText(max(texts, key=len), Encoder(tokenizer_path()))
    n = doc.n_parts
    doc.edit(len(doc.text()) // 2, len(doc.text()) // 2 + 3, "new words")
    assert n > 1000 and doc.encoded < 10


def test_edits_of_a_long_text_keep_its_runs(texts, reference):
    """Many edits beside each other, long deletions, and a text put in that is longer than a run may be."""
    dice, encoder = random.Random(4), Encoder(tokenizer_path())
    t = max(texts, key=len)[:30_000]
    doc = CountedText(t, encoder)
    for k in range(300):
        a = dice.choice([0, len(t), len(t) // 3, dice.randint(0, len(t))])
        b = min(len(t), a + dice.choice([0, 0, 0, 1, 5, 2000 if k % 50 == 0 else 0]))
        new = " many more words" * 200 if k == 77 else dice.choice(["", " w", "x y ", "\n", "ab"])
        doc.edit(a, b, new)
        t = t[:a] + new + t[b:]
    assert doc.text() == t and doc.count() == len(reference(t)) and doc.rebuilt <= 6
    again = CountedText(t, encoder, *doc.state())
    again.edit(100, 120, "new")
    assert again.count() == len(reference(t[:100] + "new" + t[120:])) and again.encoded < 10


def test_three_edits_of_real_documents_rebuild_nothing(texts):
    encoder = Encoder(tokenizer_path())
    for t in texts:
        doc = CountedText(t, encoder)
        for place in (len(t) // 2, max(0, len(t) - 5), 0):
            doc.edit(place, place + 3, " a few words ")
        assert doc.rebuilt == 0


def test_planted_trees_give_the_same_counts(spark, sf):
    from pyspark.sql import functions as F

    from tarnfold.llm.counting import planted

    edits = F.array(F.struct(F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("stop"), F.lit("x y").alias("new")))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = counted(docs.select("doc_id", "text", edits.alias("edits")))
    kept = counted(planted(docs).withColumn("edits", edits))
    assert sorted(plain.collect()) == sorted(kept.collect())


def test_segment_tree():
    import numpy as np

    for n in (0, 1, 2, 5, 8, 13):
        leaves = np.arange(n) + 1
        tree = SegmentTree(leaves)
        assert tree.total() == leaves.sum()
        if n > 3:
            tree.put(2, 100)
            assert tree.total() == leaves.sum() - 3 + 100
            tree.splice(0, 2, np.array([7]))
            assert tree.total() == leaves.sum() - 3 + 100 - 3 + 7 and tree.n == n - 1


def test_query_counts(spark, sf, reference):
    from tarnfold.llm.counting import op4_edit_aware_token_counts

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_edit_aware_token_counts(spark, sf).collect():
        d = docs[r.doc_id]
        half = len(d.text) // 2
        edited = (d.text[:half] + " amended " + d.text[half:])[:-5]
        edited = f"{d.lang} {d.doc_id}\n" + edited
        assert r.n_tokens == len(reference(d.text)) and r.n_tokens_edited == len(reference(edited))


def test_no_edits(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, None, [])], "doc_id long, text string, edits array<struct<start: long, stop: long, new: string>>")
    assert {(r.doc_id, r.n_tokens, r.n_tokens_edited) for r in counted(df).collect()} == {(1, 3, 3), (2, 0, 0)}
