"""Language-model scores of whole texts: a unigram base, and a causal attention model over subwords.

Words and subword frequencies are counted over all training documents.  Word counts are kept as a
table; scoring takes the most frequent ones along to every worker (``COMMON`` at most, of at most ``LONGEST``
bytes, as hashes), and joins the rest, whose keys are rare, by shuffle.  Subword counts come from the word
counts, each distinct word encoded once; they are as many as the vocabulary.

The model learns from all training documents: their subwords are laid in a row, an end between two texts, and cut
into windows, so that each subword and each end is predicted once (a small corpus has more windows, see ``each_more``).
Windows are dealt to learners, ``EACH`` to one on average.  The first learner's model is where the others start; each
goes on with its own windows, on the executors, and the models' parameters are averaged, row by row.  What stands beside
what, and what follows what, is counted over all of it.

Texts are read as their words, ASCII letters in lower case, one space before each.  Where the training documents are some of
the scored ones, each text is encoded once: its ids are stored, learnt from and scored.

Defined results: a null text is empty, and has its end only; repeated rows and ties of doc_id get the same
scores; a very long text is scored as a whole, alone in its batch; without
training documents every base probability is 1 (N = V = 0) and the model is a uniform one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import BATCH, BLOCK, CLASSES, DIM, FOLLOWERS, LEADERS, STEPS, Attention, classes_of, frequent, neighbours
from .common import held_out_mod, scratch, stored, table, whole_text
from .shingles import Powers, word_hashes
from .words import Encoder, batches, tokenizer_path

#: Words that every worker has the counts of, at most, and the bytes of the longest of them.
COMMON, LONGEST = 200_000, 64
#: Windows of a learner, on average.
EACH = STEPS * BATCH
WIDTH = 2 * BLOCK + 1
#: Bytes of ids that are worked on together.
IDS_TOGETHER = 400_000
#: Windows that a task mixes before it deals them into steps, and pairs of ids that it counts together.
MIXED, PAIRS = 256 * BATCH, 1 << 19
END_ID = 50256
SIZE = 50257


def lower_words(text: str) -> bytes:
    """Its words with single spaces between them, ASCII letters in lower case."""
    return b" ".join(text.encode().lower().split())


def word_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(word, n) over (text).  Words are counted batch by batch, then by Spark before and after its shuffle."""
    path = path or tokenizer_path()

    def count(rows):
        import pyarrow as pa

        with Encoder.lent(path) as encoder:
            for batch in batches(rows):
                texts = [t for t in map(lower_words, batch.column("text").to_pylist()) if t]
                if texts:
                    found = encoder.grouped(texts, breaks=False, encode=False)
                    n = np.bincount(found.which, minlength=len(found.keys))
                    yield pa.RecordBatch.from_arrays([found.words().cast(pa.string()), pa.array(n)], ["word", "n"])

    parts = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, n_common: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the most frequent words, ``n_common`` at most.

    A count of words by frequency tells the least frequency that keeps within that; so nothing is sorted as a whole.
    """
    short = counts.where(F.octet_length("word") <= LONGEST)
    step = F.floor(F.log2("n") * 8).cast("int")
    found = short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # some hundred rows
    least, total = None, 0
    for r in sorted(found, key=lambda r: -r["step"]):
        total += r["n"]
        if total > n_common:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    top = short.where(step >= least).toArrow()
    keys, _ = word_hashes([" ".join(top.column("word").to_pylist()).encode()], Powers())
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order].astype(np.float64)


def subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs, from (word, n)."""

    def count(rows):
        import pyarrow as pa

        total = np.zeros(SIZE)
        with Encoder.lent(path) as encoder:
            for batch in rows:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for i in range(0, len(words), 4000):
                    ids = encoder._ids(" " + " ".join(words[i : i + 4000]))
                    owner = np.cumsum(encoder.opens[ids]) - 1
                    total += np.bincount(ids, n[i : i + 4000][owner], SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "n"])

    found = words.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most SIZE rows
    counts = np.zeros(SIZE)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def windows_of(ids: np.ndarray, each: float) -> np.ndarray:
    """(n, WIDTH): windows of a text, with its ends, ``each`` for every subword on average; a shorter text is repeated."""
    flat = np.concatenate(([END_ID], ids, [END_ID])).astype("<u2")
    rng = np.random.default_rng(zlib.crc32(flat.tobytes()))
    n = int(each * (len(ids) + 1) + rng.random())
    if len(flat) < WIDTH:
        flat = np.append(np.tile(flat[:-1], -(-WIDTH // (len(flat) - 1))), END_ID).astype("<u2")
    return flat[rng.integers(0, len(flat) - WIDTH + 1, n)[:, None] + np.arange(WIDTH)]


def stretches(texts: list[bytes], each: float, most: int = 60 * WIDTH) -> tuple[list[bytes], list[int], list[bytes]]:
    """Where windows of texts are: stretches of WIDTH words (fewer, if those are long) from anywhere in them, and of each
    what is at its limits (1: the text's beginning, 2: its end, 3: both); ``each`` for every byte on average.

    Words are in lower case, one space between them.  Texts of less than ``most`` bytes are returned whole.
    """
    out, limits, short = [], [], []
    rng = np.random.default_rng(zlib.crc32(b"".join(t[:64] for t in texts)))
    for text in texts:
        if len(text) <= most:
            short.append(b" ".join(text.lower().split()))
            continue
        for at in rng.integers(0, len(text), int(each * len(text) + rng.random())).tolist():
            at = 0 if at < 8 else min(at, len(text) - most)  # what begins near the end is the end
            words = text[at : at + most].lower().split()
            last = at + most >= len(text)
            words = words[at > 0 : len(words) - (not last)]  # words that the limits may have cut
            words = words[-WIDTH:] if last else words[:WIDTH]
            if words:
                out.append(b" ".join(words))
                limits.append((at == 0) + 2 * last)
    return out, limits, [t for t in short if t]


def cut_up(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WIDTH): windows in which every id of ``row`` but its first is predicted once, and the rest that fills none, with the id before it."""
    n = (len(row) - 1) // (WIDTH - 1)
    return row[(np.arange(n) * (WIDTH - 1))[:, None] + np.arange(WIDTH)], row[n * (WIDTH - 1) :]


def encoded(rows, path: str):
    """Of batches of ``text``: the ids of all texts in a row, and where each text's end."""
    with Encoder.lent(path) as encoder:
        for batch in batches(rows):
            texts = list(map(lower_words, batch.column("text").to_pylist()))
            ends, full = np.zeros(len(texts), np.int64), [t for t in texts if t]
            ids = np.zeros(0, np.uint16)
            if full:
                found = encoder.grouped(full, breaks=False)
                ids, to = found.ids()
                ends[[i for i, t in enumerate(texts) if t]] = np.diff(to[found.at])
            yield ids, np.cumsum(ends)


def ids_of(rows):
    """Of batches that have ``ids``: the same as encoded() has of their texts."""
    for batch in batches(rows, lambda batch: batch.column("ids"), IDS_TOGETHER):
        yield ids_in(batch.column("ids"))


def ids_in(column) -> tuple[np.ndarray, np.ndarray]:
    """The ids in an Arrow array of binary values, all in a row, and where each value's end."""
    limits = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]].view("<u2") if limits[-1] > limits[0] else np.zeros(0, "<u2")
    return ids, (limits[1:] - limits[0]).astype(np.int64) // 2


def learnt_from(training: DataFrame, counts: np.ndarray, path: str, each_more: float = 0.0) -> DataFrame:
    """From (text), or from ``ids`` as read() has them: rows of windows (``ids``, one after the other, ``n``: how many pairs at their beginning stand in another
    row too), and rows of neighbour counts (``cell`` of neighbours(), ``n``).  All texts are in them as a whole.

    ``each_more``: windows from anywhere beside those, for every subword on average.
    """
    top, place, wide = frequent(counts)
    texts = "text" in training.columns

    def encode(rows):
        import pyarrow as pa

        near = np.zeros((len(top), 2 * wide), np.int64)
        rest = before = np.array([END_ID], "<u2")  # what is in no window yet, and what stands there before it
        pools: dict[bool, list] = {False: [], True: []}  # windows of the row, more windows
        pending = [rest]  # what neighbours are not counted in yet

        def count():
            found = np.concatenate(pending)
            near[:] += neighbours(found[:-1], found[1:], place, len(top), wide)
            pending[:] = [found[-1:]]

        def table(windows: list, elsewhere: list):
            return pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in windows], pa.binary()), pa.nulls(len(windows), pa.int64()), pa.array(elsewhere, pa.int64())], ["ids", "cell", "n"])

        def dealt(more: bool, least: int):
            if sum(map(len, pools[more])) >= least:
                found = np.concatenate(pools[more])
                found = found[np.random.default_rng(zlib.crc32(found[0].tobytes())).permutation(len(found))]
                keep = len(found) % BATCH if least > 1 else 0
                pools[more] = [found[len(found) - keep :]]
                steps = [found[i : i + BATCH] for i in range(0, len(found) - keep, BATCH)]
                yield table(steps, [len(w) * (WIDTH - 1) * more for w in steps])

        for ids, ends in encoded(rows, path) if texts else ids_of(rows):
            if each_more:
                pools[True] += [windows_of(x, each_more) for x in np.split(ids, ends[:-1]) if len(x)]
            own = np.insert(ids, ends, END_ID).astype("<u2")
            pending.append(own)
            if sum(map(len, pending)) > PAIRS:
                count()
            before = np.concatenate((before, own))[-WIDTH:]
            windows, rest = cut_up(np.concatenate((rest, own)))
            pools[False].append(windows)
            for more in pools:
                yield from dealt(more, MIXED)
        for more in pools:
            yield from dealt(more, 1)
        if len(rest) > 1:  # filled up with what stands before it, or with itself
            if len(before) < WIDTH:
                before = np.append(np.tile(before[:-1], -(-WIDTH // (len(before) - 1))), before[-1:])[-WIDTH:]
            yield table([before], [WIDTH - len(rest)])
        count()
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(near.ravel()[at])], ["ids", "cell", "n"])

    return training.select(whole_text().alias("text") if texts else F.col("ids")).mapInArrow(encode, "ids binary, cell long, n long")


def steps_of(rows: list[bytes]) -> tuple:
    """Batches of ids for Attention.learn(), from rows of windows, in an order of their own; and how many they are."""
    found = np.frombuffer(b"".join(sorted(rows, key=zlib.crc32)), "<u2").reshape(-1, WIDTH)
    return (found[i : i + BATCH].astype(np.int64) for i in range(0, len(found), BATCH)), -(-len(found) // BATCH)


def trained(training: DataFrame, counts: np.ndarray, path: str, each_learner: int = EACH) -> Attention:
    """The attention model, fitted on all of (text) or ``ids``; ``counts`` are those of its ids."""
    total = counts.sum()
    if not total:
        return Attention(np.zeros(SIZE), np.arange(SIZE) % CLASSES, END_ID)
    wanted = max(total / (WIDTH - 1), STEPS * BATCH)
    found = stored(learnt_from(training, counts, path, wanted / total - 1 / (WIDTH - 1)), "learnt")
    top, _, wide = frequent(counts)
    sums = found.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 1500 * 600 numbers
    near = np.zeros(len(top) * 2 * wide)
    near[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    kind = classes_of(counts, near.reshape(len(top), 2 * wide), counts, Encoder.shared(path).opens)
    n_learners = max(1, round(wanted / each_learner))
    windows = found.where("ids IS NOT NULL").select("ids", "n", F.pmod(F.xxhash64("ids"), F.lit(n_learners)).alias("learner"))
    first = windows.where("learner = 0").select("ids").toArrow().column("ids").to_pylist()  # about each_learner * 66 bytes
    model = Attention(counts, kind, END_ID)
    model.learn(*steps_of(first))
    if n_learners > 1:
        _go_on(model, windows.where("learner > 0").select("ids", "learner"), n_learners - 1)
    often = np.argsort(-counts, kind="stable")[:FOLLOWERS]
    model.follow(often, often[:LEADERS], followers(windows.select("ids", "n"), kind, often))
    return model


def followers(windows: DataFrame, kind: np.ndarray, top: np.ndarray) -> np.ndarray:
    """(CLASSES + leaders, len(top)): how often each id of ``top`` stands after an id of a class, and after each of the first LEADERS of ``top``, in rows of windows (``ids``) without their first ``n`` pairs."""
    place = np.full(len(kind), -1)
    place[top] = np.arange(len(top))
    n_rows = CLASSES + min(LEADERS, len(top))

    def count(rows):
        import pyarrow as pa

        total, one = np.zeros(n_rows * len(top), np.int32), np.int32(1)
        for batch in rows:
            for some, elsewhere in zip(batch.column("ids"), batch.column("n").to_pylist()):
                ids = np.frombuffer(some.as_buffer(), "<u2").reshape(-1, WIDTH)
                before, after = ids[:, :-1].ravel()[elsewhere:], place[ids[:, 1:].ravel()[elsewhere:]]
                ok = after >= 0
                before, after = before[ok], after[ok]
                np.add.at(total, kind[before] * len(top) + after, one)
                leader = place[before]
                ok = (leader >= 0) & (leader < n_rows - CLASSES)
                np.add.at(total, (CLASSES + leader[ok]) * len(top) + after[ok], one)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    sums = windows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most (CLASSES + LEADERS) * FOLLOWERS numbers
    out = np.zeros(n_rows * len(top))
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(n_rows, len(top))


def _go_on(model: Attention, windows: DataFrame, n_learners: int) -> None:
    """Every learner goes on from ``model`` with its windows; the model becomes the average of what they come to.

    A row of parameters is averaged over the learners that changed it, so that what one alone has seen counts in full.
    """
    shared = windows.sparkSession.sparkContext.broadcast(model)  # some numbers for each id

    def fit(key, t):
        import copy

        import pyarrow as pa

        own = copy.deepcopy(shared.value)
        before = own.rows()[0]
        own.learn(*steps_of(t.column("ids").to_pylist()), rate=0.004)
        change = own.rows()[0] - before
        at = np.flatnonzero(np.abs(change).max(1) > 0)
        return pa.table([pa.array(at), pa.FixedSizeListArray.from_arrays(pa.array(change[at].ravel().astype(np.float32)), DIM).cast(pa.list_(pa.float32()))], ["row", "change"])

    found = windows.groupBy("learner").applyInArrow(fit, "row long, change array<float>")
    mean = [F.avg(F.col("change")[i].cast("double")).alias(f"c{i}") for i in range(DIM)]
    got = found.groupBy("row").agg(*mean).toArrow()  # at most the rows of the model
    shared.destroy()
    rows = model.rows()[0].astype(np.float64)
    rows[got.column("row").to_numpy()] += np.stack([got.column(f"c{i}").to_numpy() for i in range(DIM)], 1)
    model.put_rows(rows)


def read(docs: DataFrame, common, path: str, learnt=None) -> DataFrame:
    """Per (doc_id, text): its ids, what the common words give, the other words with their counts, and whether ``learnt`` holds.

    ``common`` broadcasts common_words().  ``row`` numbers the rows; store the result before it is used twice.
    """

    def count(rows):
        import pyarrow as pa
        from pyspark import TaskContext

        keys, counts = common.value
        logs = np.log10(counts + 1)
        row = TaskContext.get().partitionId() << 36
        with Encoder.lent(path) as encoder:
            for batch in batches(rows):
                texts = list(map(lower_words, batch.column("text").to_pylist()))
                n, full = len(texts), np.array([i for i, t in enumerate(texts) if t], np.int64)
                words, known, base, rare, sizes = (np.zeros(n, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64))
                ids = np.zeros(0, np.uint16)
                others = pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32())], ["word", "tf"])
                if len(full):
                    found = encoder.grouped([texts[i] for i in full], breaks=False)
                    ids, ends = found.ids()
                    sizes[full] = np.diff(ends[found.at])
                    own = np.zeros(len(found.keys))
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, found.keys), len(keys) - 1)
                        own = np.where(keys[at] == found.keys, logs[at], 0.0)
                    values = own[found.which]
                    base[full] = np.add.reduceat(values, found.at[:-1])
                    words[full] = np.diff(found.at)
                    out = np.flatnonzero(values == 0)
                    whose = full[np.searchsorted(found.at, out, "right") - 1]
                    known[:] = words - np.bincount(whose, minlength=n)
                    pair, tf = np.unique(whose * len(own) + found.which[out], return_counts=True)
                    rare = np.bincount(pair // len(own), minlength=n)
                    others = pa.StructArray.from_arrays([found.words(pair % len(own)).cast(pa.string()), pa.array(tf, pa.int32())], ["word", "tf"])
                limits = lambda each, size=1: pa.array(np.concatenate(([0], np.cumsum(each) * size)), pa.int32())
                lists = pa.ListArray.from_arrays(limits(rare), others)
                binary = pa.Array.from_buffers(pa.binary(), n, [None, limits(sizes, 2).buffers()[1], pa.py_buffer(ids.astype("<u2").tobytes())])
                columns = [batch.column("doc_id"), pa.array(np.arange(row, row + n)), batch.column("learnt"), pa.array(words + 1), pa.array(known), pa.array(base), lists, binary]
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "learnt", "n_tokens", "known", "base", "rare", "ids"])

    schema = "doc_id long, row long, learnt boolean, n_tokens long, known long, base double, rare array<struct<word: string, tf: int>>, ids binary"
    learnt = F.lit(False) if learnt is None else F.coalesce(learnt, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), learnt.alias("learnt")).mapInArrow(count, schema)


def scored(found: DataFrame, shared) -> DataFrame:
    """The rows of read() with the model's score in place of ids; ``shared`` broadcasts a Scorer."""
    names = ["doc_id", "row", "n_tokens", "known", "base"]

    def score(rows):
        import pyarrow as pa

        for batch in batches(rows, lambda batch: batch.column("ids"), IDS_TOGETHER):
            ids, ends = ids_in(batch.column("ids"))
            scores = shared.value.score(np.split(ids, ends[:-1]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(scores)], [*names, "score"])

    return found.select(*names, "ids").mapInArrow(score, "doc_id long, row long, n_tokens long, known long, base double, score double")


def language_scores(docs: DataFrame, training: DataFrame | Column, path: str | None = None, n_common: int = COMMON) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for ``docs``, learning from ``training``: other documents, or those of ``docs`` for which it holds, which are then encoded once."""
    path = path or tokenizer_path()
    others = isinstance(training, DataFrame)
    chosen = training if others else docs.where(training)
    counts = stored(word_counts(chosen, path), "words")
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = chosen.count()
    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    subwords = subword_counts(counts, path)
    subwords[END_ID] = n_docs
    context = docs.sparkSession.sparkContext
    common = context.broadcast(common_words(counts, n_common))  # at most n_common numbers
    found = stored(read(docs, common, path, None if others else training), "read")
    common.destroy()  # else workers keep it
    with scratch():
        scorer = trained(training if others else found.where("learnt").select("ids"), subwords, path).tables()
    shared = context.broadcast(scorer)  # tables by id
    scores = stored(scored(found, shared), "scored")
    shared.destroy()
    rare = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_base"), F.sum("tf").alias("rare_known"))
    end = F.lit(float(np.log10(n_docs + 1.0)))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    out = scores.join(rare, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_causal_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = language_scores(docs, ~held_out_mod(7, 2))
    return scores.withColumn("held_out", held_out_mod(7, 2))
