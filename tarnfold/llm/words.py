"""Fast exact token ids for whole texts, on top of the tokenizer library.

The byte-level vocabulary never joins what stands on the two sides of the start of `` x``, a space before
another character; nor does it join a line break that stands between two words to either.  So a text's
ids are the ids of its pieces in a row.  Pieces repeat: their ids are kept by their hashes, in arrays, and the
missing ones of a batch are encoded together.  Texts with other white space are cut and encoded piece by piece.
"""

from __future__ import annotations

import contextlib
import re
import sys

import numpy as np

from .shingles import Powers, scramble

#: Pieces that a task keeps the ids of, and how many ids; the table starts afresh beyond either.
KEEP, KEEP_IDS = 300_000, 2_000_000
#: The same of pieces that are kept as they are, and the characters of the longest.
KEEP_ODD, LONGEST_ODD = 20_000, 200
#: Characters of text that are worked on together.
TOGETHER = 500_000
END_ID = 2


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its tasks, and what one leaves the next can't use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def is_latin(text: str) -> bool:
    """Whether it has no letters from beyond U+024F."""
    try:
        text.encode("latin-1")  # nearly always, and many times as fast
    except UnicodeEncodeError:
        return max(text) < "\u0250"
    return True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """From a vocabulary file of ``tokenizers``.

    Pieces of Latin letters, which are nearly all, are encoded by ``tiktoken`` from the same vocabulary, for
    its speed; ``tokenizers`` does the rest, where the two libraries' tables of letters might differ.

    The vocabulary's added tokens stand for themselves wherever their strings are, as in the library; what is
    between them is encoded by itself.

    ``kept`` has the ids of pieces: a word stands for itself after a space or, with another hash, after a line
    break.  ``odd`` has those of any pieces, as unsigned 16-bit bytes.  Both are bounded, and a task drops them when it ends.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        if any(t[x] for t in file["added_tokens"] for x in plain):
            raise ValueError("added tokens that take white space along or stand alone only are not supported")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)"
        self._between = re.compile(f"({names})")
        #: Places where no token reaches across: before a space that stands before another character (but not within white space before an added token), and before a line break between two such.
        self.cut = re.compile(rf"(?<=\S)(?= \S)|(?<=\s)(?= \S)(?! (?:{names}))|(?<=\S)(?=\n\S)")
        special = self.special
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
        self._latin = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._path, self._whole = path, None
        self.opens = np.zeros(max(ranks.values()) + 2, bool)  # and an id for an end
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.newline = ranks[b"\n"]
        self.forget()

    def forget(self) -> None:
        """Drops what texts have left here."""
        self.kept = Kept()
        self.odd: dict[str, bytes] = {}
        self.powers = Powers()
        self._whole = None

    @staticmethod
    @contextlib.contextmanager
    def lent(path: str | None = None):
        """The process's encoder for the time of a task."""
        encoder = Encoder.shared(path)
        try:
            yield encoder
        finally:
            encoder.forget()
            give_back()

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    @staticmethod
    def shared(path: str | None = None) -> Encoder:
        """One for each process: workers run many tasks."""
        path = path or tokenizer_path()
        kept = sys.__dict__.setdefault("_tarnfold_encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    def _ids(self, text: str) -> np.ndarray:
        """Of a text in which added tokens' strings are ordinary text."""
        if not text:
            return np.zeros(0, np.uint16)
        if is_latin(text):
            return np.array(self._latin(text), np.uint16)
        if self._whole is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self._whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _encoded(self, words, broken: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids in a row of an Arrow array of words, each after a space, or after a line break that counts to it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes, ids = [], []
        mark = "\n" if broken else " "
        for i in range(0, len(words), 4000):
            part = words.slice(i, 4000)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.cast(pa.string())), mark)[0].as_py()
            if is_latin(text):
                own = self._ids(mark + text)
                at = np.flatnonzero(own == self.newline if broken else self.opens[own])
                if len(at) == len(part):
                    sizes.append(np.diff(np.append(at, len(own))))
                    ids.append(own)
                    continue
            # other letters, or line breaks that melted into other white space
            each = [self._ids(mark + w) for w in part.to_pylist()]
            sizes.append(np.array([len(x) for x in each]))
            ids += each
        return np.concatenate(sizes), np.concatenate(ids)

    def plain(self, text: str) -> bool:
        """Whether a text has words with single spaces and line breaks between them only, as grouped() takes them."""
        return not (not text or "\n\n" in text or "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1] in " \n" or self.has_special(text))

    def odd_ids(self, piece: str) -> bytes:
        """Ids of any piece between two cuts, added tokens included."""
        found = self.odd.get(piece)
        if found is None:
            if self.has_special(piece):
                parts = self._between.split(piece)
                ids = [np.array([self.special[p]], np.uint16) if k % 2 else self._ids(p) for k, p in enumerate(parts)]
                found = np.concatenate(ids).tobytes()
            else:
                found = self._ids(piece).tobytes()
            if len(piece) <= LONGEST_ODD:
                if len(self.odd) >= KEEP_ODD:
                    self.odd.clear()
                self.odd[piece] = found
        return found

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end, as unsigned 16-bit integers."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if self.plain(t):
                plain.append(i)
            else:
                out[i] = np.frombuffer(b"".join(map(self.odd_ids, self.cut.split(t))), np.uint16)
        if plain:
            found = self.grouped([texts[i].encode() for i in plain])
            ids, ends = found.ids()
            for i, a, b in zip(plain, ends[found.at[:-1]].tolist(), ends[found.at[1:]].tolist()):
                out[i] = ids[a + 1 : b]  # without the line break before the text
        return out

    def grouped(self, texts: list[bytes], breaks: bool = True, encode: bool = True) -> Grouped:
        """The pieces of texts with single spaces and line breaks between words only, equal ones found by their hashes.

        Without ``breaks`` every piece stands after a space.
        """
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.powers.reach(len(raw) + 1)
        apart = (raw == 32) | (raw == 10)
        ends = np.flatnonzero(apart)
        starts = np.concatenate(([0], ends[:-1] + 1))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.powers.up[: len(raw)], out=sums[1:])
        key = scramble((sums[ends] - sums[starts]) * self.powers.down[starts])
        if breaks:
            broken = np.concatenate(([True], raw[ends[:-1]] == 10))
            key[broken] = scramble(key[broken] + np.uint64(1))
        order = np.argsort(key)
        ascending = key[order]
        new = np.concatenate(([True], ascending[1:] != ascending[:-1]))
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        first, keys = order[new], ascending[new]
        at = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1))
        found = Grouped(raw, apart, starts, ends, first, which, keys, at)
        if encode:
            begin, size = self.kept.find(keys)
            missing = np.flatnonzero(size < 0)
            if len(missing):
                if self.kept.full():
                    self.kept = Kept()
                    missing = np.arange(len(keys))
                own = broken[first[missing]] if breaks else np.zeros(len(missing), bool)
                for kind in (False, True):
                    some = missing[own == kind]
                    if len(some):
                        self.kept.add(keys[some], *self._encoded(found.words(some), kind))
                begin, size = self.kept.find(keys)
            found.kept, found.begin, found.size = self.kept.ids, begin, size
        return found


class Kept:
    """Ids of pieces by hash: two sorted tables, of which the lesser takes what is new, over one array of ids."""

    def __init__(self):
        self.ids, self.n = np.zeros(1 << 16, np.uint16), 0
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def full(self) -> bool:
        return self.n > KEEP_IDS or sum(len(t[0]) for t in self.tables) > KEEP

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of ascending hashes begin, and how many they are (-1: not here)."""
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for own, starts, sizes in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                begin[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return begin, size

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.n + len(ids) > len(self.ids):
            wider = np.zeros(2 * (self.n + len(ids)), np.uint16)
            wider[: self.n] = self.ids[: self.n]
            self.ids = wider
        self.ids[self.n : self.n + len(ids)] = ids
        new = (keys, self.n + np.cumsum(sizes) - sizes, sizes)
        self.n += len(ids)
        great, less = self.tables
        less = self._merged(less, new)
        if 4 * len(less[0]) > len(great[0]):
            great, less = self._merged(great, less), (keys[:0], sizes[:0], sizes[:0])
        self.tables = [great, less]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate((a[0], b[0])))
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b))


class Grouped:
    """Pieces of texts: the hashes of distinct ones (``keys``, ascending), which of them stands at each place (``which``),
    and at which place each text begins (``at``, one more at the end)."""

    def __init__(self, raw, apart, starts, ends, first, which, keys, at):
        self.raw, self.apart, self.starts, self.ends, self.first = raw, apart, starts, ends, first
        self.which, self.keys, self.at = which, keys, at

    def words(self, some: np.ndarray | None = None):
        """An Arrow array of distinct pieces, or of some of them, without the space or break before them."""
        import pyarrow as pa

        first = self.first if some is None else self.first[some]
        sizes = (self.ends - self.starts)[first]
        ends = np.cumsum(sizes)
        data = self.raw[np.repeat(self.starts[first] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate(([0], ends))
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))

    def chars(self) -> np.ndarray:
        """Characters at each place."""
        begun = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))  # before each byte
        return begun[self.ends] - begun[self.starts]

    def sizes(self) -> np.ndarray:
        """How many ids each place has."""
        return self.size[self.which]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places in a row, and where each place's begin (one more at the end)."""
        each = self.sizes()
        ends = np.concatenate(([0], np.cumsum(each)))
        return self.kept[np.repeat(self.begin[self.which] - ends[:-1], each) + np.arange(ends[-1])], ends


def batches(rows, text=lambda batch: batch.column("text"), chars: int = TOGETHER):
    """Slices of Arrow record batches with about so many bytes of text each; long texts come alone."""
    import pyarrow.compute as pc

    try:
        for batch in rows:
            ends = np.cumsum(np.nan_to_num(pc.binary_length(text(batch)).to_numpy(zero_copy_only=False)))
            start, n = 0, batch.num_rows
            while start < n:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + chars, "right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()
