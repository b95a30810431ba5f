import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarnfold.llm import packing
from tarnfold.llm.common import stored, table
from tarnfold.llm.words import tokenizer_path


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_pieces_and_places(spark, request, which):
    path = request.getfixturevalue(which)
    t = Tokenizer.from_file(tokenizer_path())
    
    want = collections.Counter()
    for d in table(spark, path, "documents").collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        first, start = (len(ids) - 1) % 1024 + 1, 0
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            want[d.doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start = end
    rows = packing.op10_best_fit_swaps(spark, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_sequences(rows)


def check_sequences(rows, capacity=1024, spare=2):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r["offset"], r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + spare


def test_blocks_are_packed_once_more(spark, sf):
    found = stored(packing.pieces(table(spark, sf, "documents")), "pieces")
    rows = packing.pack(found, block_pieces=20).collect()
    assert len(rows) == found.count()
    check_sequences(rows, spare=12)
    again = packing.pack(found, block_pieces=20).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_best_fit_takes_the_tightest_bin():
    assert sorted(map(sorted, packing.best_fit(np.array([6, 7, 4, 3]), 10))) == [[0, 2], [1, 3]]


@pytest.mark.parametrize("seed", range(8))
def test_search_never_loses_a_piece_and_never_needs_more_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60 if seed % 2 else 101, 400)
    before = packing.best_fit(lengths, 100)
    after = packing.swap_search([list(b) for b in before], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(400))
    assert all(lengths[b].sum() <= 100 for b in after) and len(after) <= len(before)
    squares = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
    assert squares(after) >= squares(before)


def test_swaps_empty_a_bin():
    """Best fit alone leaves three bins; exchanging pieces leaves two."""
    lengths = np.array([50, 30, 20, 45, 35, 20])
    start = [[0, 1], [3, 4], [2, 5]]
    assert len(packing.swap_search(start, lengths, 100)) == 2


def test_search_ends_when_no_step_is_left():
    """Best fit leaves some hundred underfull bins; any of them may give to any fuller one."""
    lengths = np.random.default_rng(5).integers(210, 421, 1200)
    before = packing.best_fit(lengths, 1024)
    after = packing.swap_search([list(b) for b in before], lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(1200)) and len(after) < len(before) - 5
    bins = sorted((int(lengths[b].sum()), lengths[b].tolist()) for b in after if lengths[b].sum() < 1024)
    for k, (_, giver) in enumerate(bins):
        outs = {*giver, *(x + y for i, x in enumerate(giver) for y in giver[:i])}
        for fill, taker in bins[k + 1 :]:
            assert not any(0 < out - back <= 1024 - fill for out in outs for back in (0, *taker))


def test_pairs_are_tried_in_bins_of_many_pieces():
    lengths = np.array([1] * 30 + [2] * 40 + [5] * 3 + [993, 4])
    most = packing._most(lengths[:73], 1024)
    assert most[:11].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 10]
