"""Token counts that follow edits without counting a text anew.

A document is kept as its pre-tokens (a word with the space or line break before it) and segment trees
of their characters and token counts.  No token reaches from one into the next, so an edit changes only those
that it touches and the one on either side, whose limits it may have moved: they are found by the tree of
characters, cut again and encoded, their leaves replaced, and the sums above them updated.

Defined results: a null or empty text has 0 tokens; an added token's string in a text counts as that
token; an edit's places are cut to the text; a very long text is one document like any other, alone in its
batch; repeated rows and ties of doc_id are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text
from .words import Encoder, batches, tokenizer_path


class SegmentTree:
    """Sums over leaves, in a list: the node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: np.ndarray):
        self.n = len(leaves)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        node = np.zeros(2 * self.size, np.int64)
        node[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            half = level // 2
            node[half:level] = node[level : 2 * level : 2] + node[level + 1 : 2 * level : 2]
            level = half
        self.node = node.tolist()

    def total(self) -> int:
        return self.node[1]

    def put(self, at: int, count: int) -> None:
        at += self.size
        change = count - self.node[at]
        while at:
            self.node[at] += change
            at //= 2

    def find(self, amount: int) -> tuple[int, int]:
        """The leaf in which the running sum goes beyond ``amount`` (the last one that has any if none does), and the sum before it."""
        i, before = 1, 0
        amount = min(amount, self.node[1] - 1)
        while i < self.size:
            i *= 2
            if before + self.node[i] <= amount:
                before += self.node[i]
                i += 1
        return i - self.size, before

    def splice(self, start: int, stop: int, leaves: np.ndarray) -> None:
        """Puts leaves in place of start..stop: in place if they are as many, else the tree is built again from known counts."""
        if len(leaves) == stop - start:
            for k, count in enumerate(np.asarray(leaves).tolist()):
                self.put(start + k, count)
        else:
            old = self.node[self.size : self.size + self.n]
            self.__init__(np.array([*old[:start], *leaves, *old[stop:]], np.int64))


#: Pre-tokens in a run at first, and at most.
RUN, MOST = 32, 128


class CountedText:
    """A text under edits, with its token count.

    Pre-tokens stand in short runs, which are the leaves of two segment trees: of characters, by which an edit
    finds its place, and of tokens.  An edit rewrites one run or a few and updates the sums above them; only
    if a run has come to MOST pre-tokens are all runs laid out anew, from known counts.  ``encoded`` counts the
    pre-tokens that edits had encoded, ``rebuilt`` how often runs were laid out anew.
    """

    def __init__(self, text: str, encoder: Encoder, lengths: np.ndarray | None = None, counts: np.ndarray | None = None):
        """``lengths`` and ``counts`` are those of the text's pre-tokens, from state() or from known pieces."""
        self.encoder, self.encoded, self.rebuilt = encoder, 0, 0
        if lengths is None:
            parts = encoder.cut.split(text) if text else []
            lengths, counts = np.array([len(p) for p in parts], np.int64), self._counts(parts)
        self._lay(text, lengths, counts)

    def _lay(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.n_parts = len(lengths)
        firsts = np.arange(0, max(1, self.n_parts), RUN)
        some = self.n_parts > 0
        chars = np.add.reduceat(lengths, firsts) if some else np.zeros(1, np.int64)
        self.chars = SegmentTree(chars)
        self.tokens = SegmentTree(np.add.reduceat(counts, firsts) if some else np.zeros(1, np.int64))
        # a run is its text, the lengths of its pre-tokens and their counts; until an edit it is a stretch of the whole
        self.whole, self.lengths, self.counts = text, lengths, counts
        self.starts = (np.cumsum(chars) - chars).tolist()
        self.runs: dict[int, tuple[str, list[int], list[int]]] = {}

    def _run(self, r: int) -> tuple[str, list[int], list[int]]:
        if r in self.runs:
            return self.runs[r]
        at = slice(r * RUN, (r + 1) * RUN)
        a = self.starts[r]
        return self.whole[a : a + self.chars.node[self.chars.size + r]], self.lengths[at].tolist(), self.counts[at].tolist()

    def _counts(self, parts: list[str]) -> np.ndarray:
        return np.array([len(self.encoder.odd_ids(p)) for p in parts], np.int64) // 2

    def count(self) -> int:
        return self.tokens.total()

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, counts) of the pre-tokens, from which the trees can be had again without encoding."""
        runs = [self._run(r) for r in range(self.chars.n)]
        return tuple(np.array([x for run in runs for x in run[k]], np.int64) for k in (1, 2))

    def text(self) -> str:
        return "".join(self._run(r)[0] for r in range(self.chars.n))

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters start..stop."""
        total = self.chars.total()
        start, stop = min(start, total), min(max(start, stop), total)
        low, before = self.chars.find(start)
        high = self.chars.find(stop)[0]
        text, lengths, counts = self._run(low)
        text, lengths, counts = [text], [*lengths], [*counts]
        for r in range(low + 1, high + 1):
            self._append(r, text, lengths, counts)

        def touched() -> tuple[int, int]:
            ends = np.cumsum(lengths) + before
            return int(np.searchsorted(ends, start, "right")) - 1, int(np.searchsorted(ends, stop, "left")) + 2

        while touched()[0] < 0 and low:  # the pre-token before it is in an earlier run
            low -= 1
            own = self._run(low)
            text.insert(0, own[0])
            lengths, counts = [*own[1], *lengths], [*own[2], *counts]
            before -= len(own[0])
        while touched()[1] > len(lengths) and high + 1 < self.chars.n:
            high += 1
            self._append(high, text, lengths, counts)
        a, b = touched()
        a, b = max(0, a), min(len(lengths), b)
        whole = "".join(text)
        left, right = sum(lengths[:a]), sum(lengths[:b])
        fresh = self.encoder.cut.split(whole[left : start - before] + new + whole[stop - before : right])
        fresh = [p for p in fresh if p]
        self._put(low, high, whole[:left] + "".join(fresh) + whole[right:], [*lengths[:a], *map(len, fresh), *lengths[b:]], [*counts[:a], *self._counts(fresh).tolist(), *counts[b:]])
        self.encoded += len(fresh)
        self.n_parts += len(fresh) - (b - a)

    def _append(self, r: int, text: list, lengths: list, counts: list) -> None:
        own = self._run(r)
        text.append(own[0])
        lengths += own[1]
        counts += own[2]

    def _put(self, low: int, high: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Puts pre-tokens in place of the runs low..high, spread over them."""
        each = -(-len(lengths) // (high - low + 1))
        at = 0
        for k, r in enumerate(range(low, high + 1)):
            own = slice(k * each, (k + 1) * each)
            n = sum(lengths[own])
            self.runs[r] = (text[at : at + n], lengths[own], counts[own])
            self.chars.put(r, n)
            self.tokens.put(r, sum(counts[own]))
            at += n
        if each > MOST:
            whole, (all_lengths, all_counts) = self.text(), self.state()
            self._lay(whole, all_lengths, all_counts)
            self.rebuilt += 1


def texts_of(texts: list[str], encoder: Encoder) -> list[CountedText]:
    """One for each text; equal pieces of plain texts are found and encoded together."""
    plain = [i for i, t in enumerate(texts) if encoder.plain(t)]
    out: dict[int, CountedText] = {}
    if plain:
        found = encoder.grouped([texts[i].encode() for i in plain])
        counts, lengths = found.sizes(), found.chars() + 1
        counts[found.at[:-1]] -= 1  # the line break before a text
        lengths[found.at[:-1]] -= 1
        for i, a, b in zip(plain, found.at[:-1].tolist(), found.at[1:].tolist()):
            out[i] = CountedText(texts[i], encoder, lengths[a:b], counts[a:b])
    return [out[i] if i in out else CountedText(t, encoder) for i, t in enumerate(texts)]


def planted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, lengths, counts) of (doc_id, text): the leaves of each document's trees, to be stored and edited later."""
    path = path or tokenizer_path()

    def plant(rows):
        import pyarrow as pa

        with Encoder.lent(path) as encoder:
            for batch in batches(rows):
                leaves = [d.state() for d in texts_of(batch.column("text").to_pylist(), encoder)]
                columns = [pa.array([x[k].astype(np.int32) for x in leaves], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "lengths", "counts"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(plant, "doc_id long, text string, lengths array<int>, counts array<int>")


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of (doc_id, text, edits) before and after the edits, an array of (start, stop, new) that apply in order.

    With planted()'s ``lengths`` and ``counts`` beside the text, only what edits touch is encoded.  ``encoded`` is the
    number of pre-tokens that the edits had encoded again.
    """
    path = path or tokenizer_path()
    leaves = [c for c in ("lengths", "counts") if c in docs.columns]
    leaves = leaves if len(leaves) == 2 else []

    def count(rows):
        import pyarrow as pa

        with Encoder.lent(path) as encoder:
            for batch in batches(rows):
                out = []
                texts = batch.column("text").to_pylist()
                if leaves:
                    known = [[np.array(x, np.int64) for x in batch.column(c).to_pylist()] for c in leaves]
                    found = [CountedText(t, encoder, a, b) for t, a, b in zip(texts, *known)]
                else:
                    found = texts_of(texts, encoder)
                for doc_id, doc, edits in zip(batch.column("doc_id").to_pylist(), found, batch.column("edits").to_pylist()):
                    before = doc.count()
                    for e in edits or []:
                        doc.edit(e["start"], e["stop"], e["new"])
                    out.append((doc_id, before, doc.count(), doc.n_parts, doc.encoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_encoded"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), "edits", *leaves)
    return rows.mapInArrow(count, "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_encoded long")


def op4_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, before and after three edits: a word put in the middle, the last five characters cut, its language and id put in front."""
    docs = table(spark, sf_dir, "documents")
    n = F.char_length(whole_text())
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("new"))
    half = F.floor(n / 2)
    end = n + 9
    front = F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"))
    edits = F.array(edit(half, half, F.lit(" amended ")), edit(F.greatest(F.lit(0), end - 5), end, F.lit("")), edit(F.lit(0), F.lit(0), front))
    return counted(docs.select("doc_id", "text", edits.alias("edits")))
