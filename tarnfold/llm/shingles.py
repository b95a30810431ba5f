"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_ROOT = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly, one to one."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the root and of its inverse modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more at the end)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    powers.reach(len(raw) + 1)
    blank = _BLANK[raw]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=sums[1:])
    words = scramble((sums[ends] - sums[starts]) * powers.down[starts])
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return words, np.searchsorted(starts, offsets)


def shingle_counts(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, ascending, with their counts.  A text of fewer words is one shingle; of none, no shingle."""
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    k = min(n, width)
    mixed = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(_ROOT) + words[i : n - k + 1 + i]
    mixed = np.sort(scramble(mixed))
    first = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
    return mixed[first], np.diff(np.append(first, len(mixed)))
