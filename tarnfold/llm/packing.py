"""Packing documents into token sequences: best fit, then a local search by swaps.

Documents become pieces of at most ``capacity`` tokens.  Piece lengths alone are packed, in blocks of a
fixed number of pieces that are dealt by hash, so that blocks run beside each other at any scale; what a
block leaves in badly filled bins is packed once more, over fewer blocks.

A piece's place in its block comes from piece number, doc_id, checksum and length, so that runs agree; pieces that
tie in all of them are interchangeable.  A table of one block is packed once: there are no other blocks whose badly
filled bins could be packed with its own.

Defined results: a null or empty text is its end token alone; a very long text is cut into pieces like any other,
alone in its batch; an added token's string in a text is that token; repeated rows and ties of doc_id are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, whole_text
from .words import END_ID, Encoder, batches, tokenizer_path

CAPACITY = 1024
#: Pieces in a block, as an average, and the fill under which a bin is packed once more.
BLOCK_PIECES = 60_000
FULL = 0.97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows of PIECES for (doc_id, text); with ``keep_ids`` also the token ids."""
    path = path or tokenizer_path()

    def cut(rows):
        import pyarrow as pa

        with Encoder.lent(path) as encoder:
            for batch in batches(rows):
                out = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch(batch.column("text").to_pylist())):
                    ids = np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    start = 0
                    for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                        part = ids[start:end]
                        out.append((doc_id, k, start, end - start, zlib.crc32(part.tobytes())) + ((part,) if keep_ids else ()))
                        start = end
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: each piece goes where it leaves the least room.  Bins are lists of positions."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    at_least = np.zeros(capacity + 2, np.int64)  # bins by room, as counts
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = n + int(np.argmax(at_least[n:] > 0)) if at_least[n:].any() else -1
        if room < 0 or room > capacity:
            bins.append([i])
            b, left = len(bins) - 1, capacity - n
        else:
            b = rooms[room].pop()
            at_least[room] -= 1
            bins[b].append(i)
            left = room - n
        if left:
            rooms[left].append(b)
            at_least[left] += 1
    return bins


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search between underfull bins.

    A step moves a piece, or exchanges one or two pieces against one, so that the fuller bin gets fuller
    still: each raises the sum of squared fills, so the search ends, and the emptiest bins run dry.  Passes go
    on until one changes nothing; in each, every underfull bin is tried as a giver, against every fuller one: at
    first, or once it has changed, against all, else against those that have changed since it was tried.

    Bins stand in rows, with the distinct lengths that they hold (and a 0, for a move) and what a bin would
    have room for if that piece left.  A giver is a table of the most it can give up to any size, so that one
    lookup tells what it gains everywhere.
    """
    held = [b for b in bins if lengths[b].sum() == capacity]
    short = [b for b in bins if b and lengths[b].sum() < capacity]
    if len(short) < 2:
        return held + short
    fill = np.array([lengths[b].sum() for b in short], np.int64)
    kinds = [np.unique(lengths[b]) for b in short]
    back = np.zeros((len(short), 1 + max(map(len, kinds))), np.int64)  # blanks are zeros too
    for r, k in enumerate(kinds):
        back[r, 1 : len(k) + 1] = k
    room = back + (capacity - fill)[:, None]
    steps = 0
    changed, tried = np.zeros(len(short), np.int64), np.full(len(short), -1)  # by the number of steps before
    settled = -1
    while settled != steps:
        settled = steps
        for giver in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[giver] < capacity:
                # a giver that is as it was has nothing for takers that are as they were
                some = np.flatnonzero((changed > tried[giver]) & (fill >= fill[giver])) if changed[giver] <= tried[giver] else np.flatnonzero(fill >= fill[giver])
                tried[giver] = steps
                some = some[some != giver]
                if not len(some):
                    break
                most = _most(lengths[short[giver]], capacity)
                gain = most[room[some]] - back[some]
                best = gain.max(1)
                worth = np.where(best > 0, best * (fill[some] - fill[giver] + best), 0)
                found = int(worth.argmax())
                if not worth[found]:
                    break
                taker, column = int(some[found]), int(gain[found].argmax())
                out = _pieces_of(int(most[room[taker, column]]), short[giver], lengths)
                size = int(back[taker, column])
                given = [next(i for i in short[taker] if lengths[i] == size)] if size else []
                short[giver] = [i for i in short[giver] if i not in out] + given
                short[taker] = [i for i in short[taker] if i not in given] + out
                steps += 1
                for r in (giver, taker):
                    k = np.unique(lengths[short[r]])
                    if len(k) >= back.shape[1]:
                        back = np.pad(back, ((0, 0), (0, len(k) + 1 - back.shape[1])))
                        room = back + (capacity - fill)[:, None]
                    fill[r] = lengths[short[r]].sum()
                    back[r] = 0
                    back[r, 1 : len(k) + 1] = k
                    room[r] = back[r] + capacity - fill[r]
                    changed[r] = steps
    return held + [b for b in short if b]


def _most(own: np.ndarray, capacity: int) -> np.ndarray:
    """For 0 to ``capacity``, the most that one piece or two of ``own`` come to without being more."""
    a, b = np.triu_indices(len(own), 1) if len(own) <= 64 else (None, None)
    if a is None:  # many pieces have few distinct lengths
        kinds, n = np.unique(own, return_counts=True)
        pairs = np.concatenate([(kinds[:, None] + kinds[None, :])[~np.eye(len(kinds), dtype=bool)], 2 * kinds[n > 1]])
    else:
        pairs = own[a] + own[b]
    sizes = np.zeros(capacity + 1, np.int64)
    for x in (own, pairs[pairs <= capacity]):
        sizes[x] = x
    return np.maximum.accumulate(sizes)


def _pieces_of(size: int, bin_: list[int], lengths: np.ndarray) -> list[int]:
    """The piece of that size, or two that come to it."""
    seen: dict[int, int] = {}
    for i in bin_:
        if lengths[i] == size:
            return [i]
    for i in bin_:
        n = int(lengths[i])
        if size - n in seen:
            return [seen[size - n], i]
        seen[n] = i
    raise AssertionError("no such pieces")


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return swap_search(best_fit(lengths, capacity), lengths, capacity)


def pack(found: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES (any further columns are kept).

    ``found`` must be a stored table: its rows are counted first, to size the blocks.
    """
    n_blocks = max(1, -(-found.count() // block_pieces))

    def packed(t, block, level):
        import pyarrow as pa
        import pyarrow.compute as pc

        # in an order of their own, so that a task that runs again packs the same
        by = [pc.fill_null(t.column(c), -1).to_numpy() for c in ("piece", "doc_id", "ids_crc32", "length")]
        order = np.lexsort(by)
        t, lengths = t.take(order), by[-1][order]
        seq, at, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, members in enumerate(pack_block(lengths, capacity)):
            own = lengths[members]
            seq[members] = (level * n_blocks + block) << 32 | b
            at[members] = np.cumsum(own) - own
            fill[members] = own.sum()
        for name, values in (("sequence_id", seq), ("offset", at), ("fill", fill)):
            t = t.append_column(name, pa.array(values))
        return t

    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks))
    out = T.StructType(found.schema.fields + T.StructType.fromDDL("block long, sequence_id long, offset long, fill long").fields)
    dealt = found.withColumn("block", block)
    done = dealt.groupBy("block").applyInArrow(lambda keys, t: packed(t, keys[0].as_py(), 0), out)
    if n_blocks == 1:
        return done.drop("block", "fill")
    done = stored(done, "packed")
    fewer = max(1, n_blocks // 16)
    loose = done.where(F.col("fill") < FULL * capacity).drop("sequence_id", "offset", "fill")
    loose = loose.withColumn("block", F.col("block") % fewer).groupBy("block").applyInArrow(lambda keys, t: packed(t, keys[0].as_py(), 1), out)
    return done.where(F.col("fill") >= FULL * capacity).unionByName(loose).drop("block", "fill")


def op10_best_fit_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "pieces"))
