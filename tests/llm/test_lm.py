import collections
import math
import zlib

import numpy as np
import pytest

from tarnfold.llm import attention, lm


@pytest.mark.parametrize("which,common", [("sf", lm.COMMON), ("sf", 50), ("odd", 5)])
def test_base_scores_against_brute_force(spark, request, which, common):
    path = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    from tarnfold.llm.common import held_out_mod

    got = lm.language_scores(docs, docs.where(~held_out_mod(7, 2)), n_common=common).collect()
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert [r[:3] for r in found] == [r[:3] for r in want] and [r[3] for r in found] == pytest.approx([r[3] for r in want])
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_without_training_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.language_scores(docs, docs.limit(0)).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens, rows[1].base_score) == (3, 0, 0, 0.0)
    assert rows[2].n_tokens == 1 and rows[2].score < 0


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    docs = [np.tile(rng.permutation(40), 20)[: rng.integers(5, 700)] for _ in range(30)]
    counts = np.bincount(np.concatenate(docs), minlength=64).astype(float)
    kind = attention.token_classes(np.concatenate(docs), counts, np.zeros(65, bool))
    return attention.Attention(counts, kind, 63).fit(docs, steps=150), docs


def by_hand(m, ids):
    """The model's probability of one text, position by position."""
    p, total, seq = m.p, 0.0, [m.end, *ids]
    for t, goal in enumerate([*ids, m.end]):
        low = max(0, (t // attention.BLOCK - 1) * attention.BLOCK)
        x = p["embed"][seq[low : t + 1]]
        s = x @ p["k"] @ (p["embed"][seq[t]] @ p["q"]) * attention.DIM**-0.5 + p["far"][t - low - np.arange(t + 1 - low)]
        a = np.exp(s - s.max())
        h = np.tanh((a / a.sum()) @ (x @ p["v"]) + p["embed"][seq[t]] @ p["r"])
        logit = h @ p["out"] + p["bias"]
        total += logit[m.kind[goal]] - np.log(np.exp(logit).sum()) + m.within[goal]
    return total / math.log(10)


def test_each_token_is_scored_once_whatever_is_beside_it(model):
    m, docs = model
    scorer, texts = m.tables(), [docs[0][:n] for n in (0, 1, 15, 16, 17, 40, 300)]
    together = scorer.score(texts, blocks=3)
    assert together == pytest.approx([by_hand(m, d.tolist()) for d in texts], rel=1e-4)
    assert together == pytest.approx([scorer.score([d])[0] for d in texts], rel=1e-5)


def test_probabilities_of_the_next_token_add_up_to_one(model):
    m, docs = model
    start = docs[0][:10]
    before = m.tables().score([start])[0] - 0
    whole = [m.tables().score([np.append(start, t)])[0] for t in range(63)]
    # P(start, t, end) summed over what may follow stays below P(start), and P(start, end) is one of the continuations
    assert sum(10.0**x for x in whole) + 10.0**before < 1
    scorer = m.tables()
    inside = np.bincount(m.kind, np.exp(m.within.astype(np.float64)), attention.CLASSES)
    assert inside[np.unique(m.kind)] == pytest.approx(1, rel=1e-4) and scorer.out.shape[1] == attention.CLASSES


def test_training_helps_and_context_is_used(model):
    m, docs = model
    raw = attention.Attention(np.ones(64), m.kind, 63).tables()
    new = [np.tile(np.random.default_rng(9).permutation(40), 10)]
    assert m.tables().score(docs[:5]).sum() > raw.score(docs[:5]).sum()
    assert m.tables().score(new)[0] > raw.score(new)[0]


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    docs = [np.arange(600) % 7 for _ in range(3)]
    counts = np.bincount(np.concatenate(docs), minlength=16).astype(float)
    kind = np.arange(16) % attention.CLASSES
    few, many = (attention.Attention(counts, kind, 15).fit(docs, steps=n).tables().score([docs[0][:200]])[0] for n in (1, 200))
    assert many > few * 0.3 and rng is not None  # a sequence that repeats is nearly certain


def test_windows_come_from_whole_texts_and_grow_with_them():
    ids = np.arange(20_000)
    few, many = (lm.windows_of(ids[:n], 1 / 10) for n in (2_000, 20_000))
    assert len(few) in (200, 201) and len(many) in (2000, 2001) and many.shape[1] == 2 * attention.BLOCK + 1
    assert many.max() > 19_900 and len(np.unique(many)) > 0.9 * len(ids)
    assert (lm.windows_of(ids[:2], 1.0)[:, :2] != 0).any() and set(np.unique(lm.windows_of(ids[:2], 9.0))) == {0, 1, lm.END_ID}


def test_the_end_of_a_long_text_is_learnt_from(spark):
    """What stands far from the beginning gets an embedding of its own."""
    text = "the cat sat on a mat " * 700 + "zebra quilt " * 700
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    path = lm.tokenizer_path()
    counts = lm.subword_counts(lm.word_counts(docs), path)
    counts[lm.END_ID] = 1
    found = lm.trained(docs, counts, path)
    before = attention.Attention(counts, found.kind, lm.END_ID)
    moved = np.abs(found.p["embed"] - before.p["embed"]).max(1)
    late = lm.subword_counts(lm.word_counts(spark.createDataFrame([("zebra quilt",)], "text string")), path)
    assert (moved[late > 0] > 0).all()


def test_held_out_texts_are_likelier_than_by_subword_frequencies(spark):
    """On documents that were not learnt from; the unigram is that of their subwords, with one added to each count."""
    from tarnfold.llm.words import Encoder

    path = "/root/testdata/sf0.01"
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    encoder = Encoder(lm.tokenizer_path())
    ids = {i: encoder._ids(" " + lm.lower_words(t).decode()) if t.split() else np.zeros(0, np.uint16) for i, t in docs.items()}
    counts = np.ones(lm.SIZE)
    for i in docs:
        if not held(i):
            counts += np.bincount(ids[i], minlength=lm.SIZE)
            counts[lm.END_ID] += 1
    unigram = np.log10(counts / counts.sum())
    got = {r.doc_id: r.score for r in lm.op9_causal_attention_scores(spark, path).where("held_out").collect()}
    assert set(got) == {i for i in docs if held(i)}
    n = sum(len(ids[i]) + 1 for i in got)
    model, plain = sum(got.values()) / n, sum(unigram[ids[i]].sum() + unigram[lm.END_ID] for i in got) / n
    assert model > plain + 0.6 and model > -1.8


def test_shares_after_another_id_add_up_to_one(model):
    m, docs = model
    after = np.random.default_rng(2).integers(0, 50, (attention.CLASSES + 12, 30)).astype(float)
    own = attention.Attention(np.arange(1, 65) * 3.0, m.kind, 63)
    own.follow(np.arange(30), np.arange(12), after)
    table, row, column = own.ratios()
    assert table.shape[0] == attention.CLASSES + 12 and row[5] == attention.CLASSES + 5 and row[40] == m.kind[40]
    inside = np.exp(own.within.astype(np.float64) + table[:, column])  # (before, id)
    for c in np.unique(m.kind):
        assert inside[:, m.kind == c].sum(1) == pytest.approx(1, rel=1e-4)


def test_stretches_come_from_whole_texts():
    text = b" ".join(b"W%d" % i for i in range(10_000, 60_000))
    found, limits, short = lm.stretches([text, b"A\n b", text, b" "], 0.002)
    assert short == [b"a b"] and abs(len(found) - 0.004 * len(text)) <= 2 and all(len(s.split()) == lm.WIDTH for s in found)
    starts = [int(s.split()[0][1:]) for s in found]
    assert min(starts) < 10_600 and max(starts) > 59_000 and all(s == s.lower() for s in found)
    ends = [int(s.split()[-1][1:]) == 59_999 for s in found]
    assert all((e >> 1) == last for e, last in zip(limits, ends)) and any(ends)
    whole = b" ".join(b"w%d" % i for i in range(10_000, 60_000))
    assert all(s in whole for s in found)
    assert lm.stretches([b"x" * 100_000], 0.01)[0] == []  # one word has no stretch


def test_learners_are_averaged(spark):
    """More learners than one learn from all windows, and keep what only one has seen."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50} the" for j in range(400))) for i in range(60)], "doc_id long, text string")
    path = lm.tokenizer_path()
    counts = lm.subword_counts(lm.word_counts(docs), path)
    counts[lm.END_ID] = 60
    one = lm.trained(docs, counts, path)
    many = lm.trained(docs, counts, path, each_learner=lm.EACH // 4)
    ids = lm.Encoder(path)._ids(" w1 the w2 the w3 the w4 the")
    assert many.tables().score([ids])[0] > 1.15 * one.tables().score([ids])[0] and np.abs(many.p["embed"] - one.p["embed"]).max() > 0


def test_common_words_stay_within_their_number(spark):
    words = spark.createDataFrame([(f"w{i}", 1000 - i) for i in range(900)] + [("x" * 100, 5000)], "word string, n long")
    keys, counts = lm.common_words(words, 100)
    assert 50 < len(keys) <= 100 and (np.diff(keys.astype(object)) > 0).all() and sorted(counts) == sorted(range(1000, 1000 - len(keys), -1))


def test_every_training_subword_is_learnt_from_once(spark):
    """What stands beside what and what follows what is that of all texts, however many, and windows have each pair once."""
    dice = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in dice.zipf(1.3, n) % 300) for n in [*dice.integers(0, 400, 3000), 9000, 1]] + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = lm.tokenizer_path()
    encoder = lm.Encoder(path)
    pairs = []
    for t in texts:
        ids = encoder._ids(" " + lm.lower_words(t).decode()).astype(np.int64) if (t or "").split() else np.zeros(0, np.int64)
        pairs.append(np.stack((np.append(lm.END_ID, ids), np.append(ids, lm.END_ID)), 1))
    pairs = np.concatenate(pairs)
    counts = np.bincount(pairs[:, 1], minlength=lm.SIZE).astype(float)
    key = lambda a, b: a.astype(np.int64) * lm.SIZE + b
    found = lm.learnt_from(docs, counts, path).collect()
    seen = []
    for r in found:
        if r.ids is not None:
            w = np.frombuffer(r.ids, "<u2").reshape(-1, lm.WIDTH)
            seen.append(key(w[:, :-1].ravel()[r.n :], w[:, 1:].ravel()[r.n :]))
    assert (np.sort(np.concatenate(seen)) == np.sort(key(*pairs.T))).all()
    top, place, wide = attention.frequent(counts)
    near = np.zeros((len(top), 2 * wide), np.int64)
    for r in found:
        if r.cell is not None:
            near.ravel()[r.cell] += r.n
    assert (near == attention.neighbours(*pairs.T, place, len(top), wide)).all()
    model = lm.trained(docs, counts, path, each_learner=lm.EACH // 4)
    n = int((counts > 0).sum())
    assert set(model.top[:n]) == set(np.unique(pairs[:, 1])) and model.after.sum() == len(pairs) + np.isin(pairs[:, 0], model.leaders).sum()
    for leader in model.leaders[:40].tolist():
        after = np.bincount(pairs[pairs[:, 0] == leader, 1], minlength=lm.SIZE)
        assert (model.after[attention.CLASSES + model.leaders.tolist().index(leader)] == after[model.top]).all()


def test_gradients_stop_at_the_end_before_a_text():
    """What stands before an end learns nothing from what comes after it."""
    moved = []
    for last in (40, 41):
        m = attention.Attention(np.ones(64), np.arange(64) % attention.CLASSES, 63)
        m.p["out"][:] = np.random.default_rng(3).normal(size=m.p["out"].shape)
        before = m.p["embed"].copy()
        ids = np.concatenate((np.arange(10), [63], np.arange(20, 41), [last]))
        m.learn([np.tile(ids, (8, 1))], 1)
        moved.append(m.p["embed"] - before)
    assert (moved[0][:10] == moved[1][:10]).all() and (moved[0][:10] != 0).any() and (moved[0][20:41] != moved[1][20:41]).any()


def test_a_step_by_parts_is_a_step(monkeypatch):
    """Windows that are worked on together, and ids looked up once, change no gradient."""
    ids = np.random.default_rng(4).integers(0, 40, (3, 45, lm.WIDTH))
    ids[:, ::7, 11] = 63
    found = []
    for part in (45, 8):
        monkeypatch.setattr(attention, "PART", part)
        m = attention.Attention(np.ones(64), np.arange(64) % attention.CLASSES, 63)
        m.p["out"][:] = np.random.default_rng(3).normal(size=m.p["out"].shape)
        found.append(m.learn(iter(ids), len(ids)).rows()[0])
    assert found[0] == pytest.approx(found[1], abs=1e-4) and np.abs(found[0]).max() > 0.1


def test_texts_are_encoded_once(spark, odd):
    """What is stored on the way has the ids of every text; learning and scoring from them is that from texts."""
    from tarnfold.llm.common import held_out_mod

    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    path, chosen = lm.tokenizer_path(), ~held_out_mod(7, 2)
    common = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0)))
    rows = lm.read(docs, common, path, chosen).collect()
    encoder = lm.Encoder(path)
    ids = lambda t: encoder._ids(" " + lm.lower_words(t).decode()).astype("<u2").tobytes() if t.split() else b""
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    want = [(str(r.doc_id), ids(r.text or ""), not held(r.doc_id)) for r in docs.collect()]
    assert sorted((str(r.doc_id), bytes(r.ids), r.learnt) for r in rows) == sorted(want)
    counts = np.bincount(np.frombuffer(b"".join(i for _, i, ok in want if ok), "<u2"), minlength=lm.SIZE).astype(float)
    counts[lm.END_ID] = sum(ok for _, _, ok in want)
    stored = lm.read(docs, common, path, chosen).where("learnt").select("ids").repartition(1)
    pairs = []
    for found in (lm.learnt_from(docs.where(chosen).repartition(1), counts, path).collect(), lm.learnt_from(stored, counts, path).collect()):
        windows = [(np.frombuffer(r.ids, "<u2").reshape(-1, lm.WIDTH).astype(np.int64), r.n) for r in found if r.ids is not None]
        pairs.append(sum(len(w[:, 1:].ravel()[n:]) for w, n in windows))
        assert sorted(np.concatenate([w[:, 1:].ravel()[n:] for w, n in windows])) == np.repeat(np.arange(lm.SIZE), counts.astype(int)).tolist()
    assert pairs[0] == pairs[1] == counts.sum()
    apart = lm.language_scores(docs, docs.where(chosen)).collect()
    once = lm.language_scores(docs, chosen).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
    assert sorted(map(key, apart)) == sorted(map(key, once))
    assert sum(r.score for r in once) == pytest.approx(sum(r.score for r in apart), rel=0.05)
