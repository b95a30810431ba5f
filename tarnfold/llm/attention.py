"""A small causal self-attention model over subword ids, trained and run in numpy.

The next subword's class is predicted from the subwords before it, within a window; the subword within
its class has its share of what follows the subword before it, if that is frequent, drawn towards its share of what
follows that one's class, drawn towards its share of the corpus.
So the softmax is over ``CLASSES`` numbers only, and the model still gives every subword a probability, which add up to one.

One layer, one head, a bias for each distance.  As positions only enter by that bias, queries, keys,
values and the residual are looked up by id.
"""

from __future__ import annotations

import numpy as np

CLASSES = 96
DIM = 16
#: Queries in a block; they see their own block as far as they may and the block before it.
BLOCK = 16
STEPS = 1200
BATCH = 96
#: Windows of a step that are worked on together, so that what they need stays in the cache.
PART = 32
#: Ids whose share of what follows is counted, the most frequent ones, ids that have followers of their own beside their
#: class, and the weight of the coarser share, in counts.
FOLLOWERS, LEADERS, TOWARDS = 4096, 512, 20.0


def frequent(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids whose neighbours are counted, the place of every id among them (-1: none), and how many of them count as neighbours."""
    top = np.argsort(-seen, kind="stable")[:1500]
    top = top[seen[top] >= 20]
    place = np.full(len(seen), -1)
    place[top] = np.arange(len(top))
    return top, place, min(len(top), 300)


def neighbours(a: np.ndarray, b: np.ndarray, place: np.ndarray, n: int, wide: int) -> np.ndarray:
    """(n, 2 * wide): how often an id stands before and after others, for ids ``a`` each followed by the one in ``b``."""
    a, b = place[a], place[b]
    near = []
    for x, y in ((a, b), (b, a)):
        ok = (x >= 0) & (y >= 0) & (y < wide)
        near.append(np.bincount(x[ok] * wide + y[ok], minlength=n * wide).reshape(n, wide))
    return np.concatenate(near, 1)


def token_classes(ids: np.ndarray, counts: np.ndarray, opens: np.ndarray, classes: int = CLASSES, seed: int = 3) -> np.ndarray:
    """classes_of() with what stands beside what in ``ids``."""
    seen = np.bincount(ids, minlength=len(counts))
    top, place, wide = frequent(seen)
    return classes_of(seen, neighbours(ids[:-1], ids[1:], place, len(top), wide), counts, opens, classes, seed)


def classes_of(seen: np.ndarray, near: np.ndarray, counts: np.ndarray, opens: np.ndarray, classes: int = CLASSES, seed: int = 3) -> np.ndarray:
    """A class for every id: frequent ones by what stands beside them (k-means over reduced neighbour counts), others by whether they open a word, and by frequency."""
    size = len(counts)
    rare = 8
    kind = (opens[:size].astype(np.int64) * (rare // 2)) + np.minimum(np.log2(counts + 1).astype(np.int64) // 4, rare // 2 - 1)
    top = frequent(seen)[0]
    if len(top) < 4 * classes:
        return kind % classes
    m = near.astype(np.float64)
    expected = m.sum(1, keepdims=True) * m.sum(0, keepdims=True) / max(m.sum(), 1)
    m = np.sqrt(np.maximum(0, np.log((m + 0.1) / (expected + 0.1))))
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    points = u[:, :20] * s[:20]
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    rng = np.random.default_rng(seed)
    k = classes - rare
    centre = points[rng.choice(len(points), k, replace=False)]
    weight = np.sqrt(seen[top])
    for _ in range(25):
        own = np.argmax(points @ centre.T, 1)
        for c in range(k):
            if (own == c).any():
                centre[c] = np.average(points[own == c], 0, weight[own == c])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    kind[top] = rare + own
    return kind


class Attention:
    """``counts``: how often the corpus has each id.  Ids are 0..len(counts) - 1; ``end`` both opens and ends a text."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray, end: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.end, self.kind = end, classes
        smooth = counts + 1.0
        inside = np.maximum(np.bincount(classes, smooth, CLASSES), 1e-9)  # a class may be empty
        self.within = (np.log(smooth) - np.log(inside)[classes]).astype(np.float32)
        part = rng.normal(0, 0.5, (CLASSES, DIM))
        self.p = {
            "embed": (part[classes] + rng.normal(0, 0.1, (len(counts), DIM))).astype(np.float32),
            **{n: rng.normal(0, DIM**-0.5, (DIM, DIM)).astype(np.float32) for n in ("q", "k", "v", "r")},
            "far": np.zeros(2 * BLOCK, np.float32),
            "out": np.zeros((DIM, CLASSES), np.float32),
            "bias": np.log(inside / inside.sum()).astype(np.float32),
        }
        self.top = np.zeros(0, np.int64)  # ids whose followers are counted
        self.leaders = np.zeros(0, np.int64)
        self.after = np.zeros((CLASSES, 0))
        self.steepness = np.zeros((len(counts), DIM), np.float32)  # of each id's embedding so far

    def fit(self, docs: list[np.ndarray], steps: int = STEPS, seed: int = 9) -> Attention:
        """Adam on windows of two blocks from the texts' ids; every position predicts the one after it."""
        width = 2 * BLOCK
        flat = np.concatenate([np.concatenate(([self.end], d, [self.end])) for d in docs] or [np.zeros(0, np.int64)]).astype(np.int64)
        if len(flat) <= width + 1:
            return self
        rng = np.random.default_rng(seed)
        starts = (rng.integers(0, len(flat) - width - 1, BATCH) for _ in range(steps))
        return self.learn((flat[at[:, None] + np.arange(width + 1)] for at in starts), steps)

    def learn(self, windows, steps: int, rate: float = 0.02) -> Attention:
        """Adam, a step for each of ``windows``: arrays (n, 2 * BLOCK + 1) of ids, about ``steps`` of them.

        As in scoring, no query sees beyond the end that stands before its text.
        """
        width = 2 * BLOCK
        p, top = self.p, rate
        names = ("q", "k", "v", "r", "out", "bias", "far")
        theta = np.concatenate([np.concatenate([p[n] for n in "qkvr"], 1).ravel(), p["out"].ravel(), p["bias"], p["far"]])
        into = lambda z: (z[: 4 * DIM * DIM].reshape(DIM, 4 * DIM), z[4 * DIM * DIM : -width].reshape(DIM + 1, CLASSES), z[-width:])  # noqa: E731  the bias is one more row of the output
        all4, out, far = into(theta)
        first, second, grad = (np.zeros_like(theta) for _ in range(3))
        g_all4, g_out, g_far = into(grad)
        gap = np.arange(width)[:, None] - np.arange(width)[None, :]
        gaps, sees = np.maximum(gap, 0), (gap >= 0).astype(np.float32)
        ones = np.ones(max(width, CLASSES, PART), np.float32)
        scale = np.ones(4 * DIM, np.float32)  # queries are scaled by their weights
        scale[:DIM] = DIM**-0.5
        embed = p["embed"]
        room: dict = {}  # arrays that parts of one size use again
        for step, ids in enumerate(windows, 1):
            total = len(ids) * width
            flat = ids[:, :-1].ravel()
            goals = self.kind.take(ids[:, 1:].ravel())
            order = np.argsort(flat.astype(np.uint16) if len(embed) <= 1 << 16 else flat, kind="stable")
            ascending = flat.take(order)
            new = np.concatenate(([True], ascending[1:] != ascending[:-1]))
            begin = np.flatnonzero(new)
            rows = ascending.take(begin)
            which = np.empty(total, np.int64)
            which[order] = np.cumsum(new) - 1
            # what comes from one id only is worked out once for each, and so is what goes back to it
            x = embed.take(rows, 0)
            weights = all4 * scale
            looked_up = x @ weights
            clash = (np.abs(looked_up[:, :DIM]).max(0) @ np.abs(looked_up[:, DIM : 2 * DIM]).max(0)) > 40
            steep = np.abs(out[:DIM]).sum(0).max() + np.abs(out[DIM]).max() > 60
            out_t = out[:DIM].T.copy()
            fade = np.exp(np.clip(far, -10, 10))[gaps] * sees
            back = np.empty((total, 4 * DIM), np.float32)
            g_out[:] = 0
            g_fade = np.zeros(width * width, np.float32)
            for low in range(0, len(ids), PART):
                before = ids[low : low + PART, :-1]
                n = len(before)
                size = n * width
                own = slice(low * width, low * width + size)
                if n not in room:
                    wide = lambda *shape: np.empty(shape, np.float32)
                    room[n] = (wide(size, 4 * DIM), wide(n, width, width), wide(n, width, width), wide(size, DIM), np.ones((size, DIM + 1), np.float32), wide(size, CLASSES), wide(size, DIM), wide(size, DIM), np.arange(0, size * CLASSES, CLASSES))
                mixed, a, ds, seen, h, e, dh, slope, at = room[n]
                parts = lambda z: z.reshape(-1, (8 if n % 8 == 0 else 1) * width, z.shape[1])  # noqa: E731  products by parts are faster
                looked_up.take(which[own], 0, mixed, "clip")
                q, k, v = (mixed.reshape(n, width, 4 * DIM)[:, :, i * DIM : (i + 1) * DIM] for i in range(3))
                np.matmul(q, k.transpose(0, 2, 1), a)
                if clash:
                    np.clip(a, -40, 40, a)
                np.exp(a, a)
                a *= fade
                for w, i in zip(*(found.tolist() for found in np.nonzero(before[:, 1:] == self.end))):
                    a[w, i + 1 :, : i + 1] = 0
                part = 1 / (a.reshape(size, width) @ ones[:width])[:, None]
                np.matmul(a, v, seen.reshape(n, width, DIM))
                seen *= part
                hidden = h[:, :DIM]
                np.add(seen, mixed[:, 3 * DIM :], dh)
                np.tanh(dh, hidden)
                np.matmul(parts(h), out, parts(e))
                if steep:
                    e -= e.max(1, keepdims=True)
                np.exp(e, e)
                whole = e @ ones[:CLASSES]
                e.ravel()[at + goals[own]] -= whole
                whole = (1 / (total * whole))[:, None]
                np.matmul(parts(e), out_t, parts(dh))
                np.multiply(hidden, hidden, slope)
                np.subtract(1, slope, slope)
                slope *= whole
                dh *= slope
                inner = back[own].reshape(n, width, 4 * DIM)
                inner[:, :, 3 * DIM :] = d = dh.reshape(n, width, DIM)
                dh *= part
                np.matmul(d, v.transpose(0, 2, 1), ds)
                seen *= dh
                ds -= (seen @ ones[:DIM]).reshape(n, width, 1)
                ds *= a
                g_fade += ones[:n] @ ds.reshape(n, -1)
                np.matmul(ds, k, inner[:, :, :DIM])
                inner[:, :, DIM : 2 * DIM] = np.matmul(ds.transpose(0, 2, 1), q)
                inner[:, :, 2 * DIM : 3 * DIM] = np.matmul(a.transpose(0, 2, 1), d)
                h *= whole
                g_out += (e.T @ h).T
                h[:, DIM] = 1
            g_far[:] = np.bincount(gaps.ravel(), g_fade, width)
            # pairs of numbers are summed as one complex number, which is twice as fast
            back = np.add.reduceat(back.take(order, 0).view(np.complex64), begin, 0).view(np.float32)
            np.matmul(x.T, back, g_all4)
            g_all4 *= scale
            g = back @ weights.T
            rate = top * min(1, step / 30) * (1 - 0.9 * min(1, step / steps))
            first += np.float32(0.1) * (grad - first)
            second += np.float32(0.01) * (grad * grad - second)
            theta -= np.float32(rate / (1 - 0.9**step)) * first / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-8))
            steepness = self.steepness.take(rows, 0) + g * g  # Adagrad: most ids are rare
            self.steepness[rows] = steepness
            embed[rows] = x - np.float32(2.5 * top) * g / (np.sqrt(steepness) + np.float32(1e-6))
        for name, z in zip(names, (*np.split(all4, 4, 1), out[:DIM], out[DIM], far)):
            p[name] = z.copy()
        return self

    def follow(self, top: np.ndarray, leaders: np.ndarray, after: np.ndarray) -> None:
        """``after``: (CLASSES + len(leaders), len(top)), how often each of the ids ``top`` follows a subword of a class, and each leader."""
        self.top, self.leaders, self.after = top, leaders, after

    def ratios(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log of an id's share after another against its share of the corpus: the table, the row of each id before, and the column of each after."""
        column = len(self.top) + self.kind
        column[self.top] = np.arange(len(self.top))
        row = self.kind.copy()
        row[self.leaders] = CLASSES + np.arange(len(self.leaders))
        inside = np.zeros((len(self.after), CLASSES))  # how often a class follows
        np.add.at(inside.T, self.kind[self.top], self.after.T)
        share = np.exp(self.within[self.top].astype(np.float64))
        seen = inside[:, self.kind[self.top]]
        own = np.log((self.after[:CLASSES] + TOWARDS * share) / (seen[:CLASSES] + TOWARDS)) - np.log(share)
        rest = np.log(TOWARDS / (inside + TOWARDS))
        above = self.kind[self.leaders]
        finer = np.log((self.after[CLASSES:] + TOWARDS * share * np.exp(own[above])) / (seen[CLASSES:] + TOWARDS)) - np.log(share)
        rest[CLASSES:] += rest[above]
        return np.concatenate((np.concatenate((own, finer)), rest), 1).astype(np.float32), row, column

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All parameters as rows of DIM numbers, and the row numbers at which each begins, in the order of ``p``; the last ones are filled up with zeros."""
        parts = [np.pad(x.ravel(), (0, -x.size % DIM)).reshape(-1, DIM) for x in self.p.values()]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def put_rows(self, rows: np.ndarray) -> None:
        begin = self.rows()[1]
        for (n, x), a, b in zip(self.p.items(), begin[:-1], begin[1:]):
            self.p[n] = rows[a:b].ravel()[: x.size].reshape(x.shape).astype(np.float32)

    def tables(self) -> Scorer:
        p = self.p
        return Scorer(p["embed"] @ p["q"] * np.float32(DIM**-0.5), p["embed"] @ p["k"], p["embed"] @ p["v"], p["embed"] @ p["r"], p["far"], p["out"], p["bias"], self.kind.astype(np.int32), self.within, self.end, self.ratios())


class Scorer:
    """What scoring needs, by id, side by side so that one lookup fetches it: keys and values, and queries and residuals.

    Keys have one more number, which shuts out the blank id, and values a one, whose sum is that of the weights;
    queries have a one for the blank id.
    """

    def __init__(self, q, k, v, r, far, out, bias, kind, within, end, ratios):
        n = len(k)
        shut = np.zeros((n, 1), np.float32)
        blank = np.zeros((1, 2 * DIM + 2), np.float32)
        blank[0, DIM] = -1e9
        self.seen = np.concatenate((np.concatenate((k, shut, v, shut + 1), 1), blank))
        self.asks = np.concatenate((np.concatenate((q, shut + 1, r), 1), np.zeros((1, 2 * DIM + 1), np.float32)))
        self.steep = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max()) > 60
        self.out, self.kind, self.within, self.end = np.concatenate((out, bias[None])), kind, within, end
        self.ratio, row, column = ratios
        self.column = column.astype(np.int32)
        self.row = np.append(row, 0).astype(np.int32) * self.ratio.shape[1]  # where an id's row of the table begins; any for the blank one
        gap = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
        self.far = np.where(gap >= 0, np.exp(np.minimum(far[np.clip(gap, 0, 2 * BLOCK - 1)], 20)), 0).astype(np.float32)

    def score(self, docs: list[np.ndarray], blocks: int = 128) -> np.ndarray:
        """log10 probability of each text: of its ids and the end.

        Texts are laid out in blocks, each with a blank block before it, so that no query sees another text.
        """
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        spans = -(-lengths // BLOCK) + 1
        starts = (np.cumsum(spans) - spans + 1) * BLOCK
        size = int(spans.sum()) * BLOCK
        blank = len(self.kind)  # an id of its own
        ids = np.full(size, blank, np.int64)
        goal = np.full(size, self.end, np.int64)
        for d, s in zip(docs, starts.tolist()):
            ids[s] = self.end
            ids[s + 1 : s + 1 + len(d)] = d
            goal[s : s + len(d)] = d
        found = np.zeros(size, np.float32)
        step = blocks * BLOCK
        width = self.out.shape[1]
        ones = np.ones(width, np.float32)
        hidden = np.ones((step, DIM + 1), np.float32)
        for a in range(BLOCK, size, step):
            b = min(size, a + step)
            n = (b - a) // BLOCK
            own = ids[a - BLOCK : b]
            seen = self.seen.take(own, 0).reshape(n + 1, BLOCK, -1)
            seen = np.concatenate((seen[:-1], seen[1:]), 1)
            asks = self.asks.take(own[BLOCK:], 0)
            s = np.matmul(asks[:, : DIM + 1].reshape(n, BLOCK, DIM + 1), seen[:, :, : DIM + 1].transpose(0, 2, 1))
            if self.steep:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            s *= self.far
            mixed = np.matmul(s, seen[:, :, DIM + 1 :])
            mixed = mixed[:, :, :DIM] / (mixed[:, :, DIM:] + np.float32(1e-30))
            h = hidden[: b - a]
            np.tanh(mixed.reshape(b - a, DIM) + asks[:, DIM + 1 :], out=h[:, :DIM])
            logit = (h.reshape(-1, (8 if n % 8 == 0 else 1) * BLOCK, DIM + 1) @ self.out).reshape(b - a, width)  # by parts, which is faster
            mine = logit.ravel().take(np.arange(0, (b - a) * width, width) + self.kind.take(goal[a:b]))
            np.exp(logit, out=logit)
            next_ = goal[a:b]
            found[a:b] = mine - np.log(logit @ ones) + self.within.take(next_) + self.ratio.ravel().take(self.row.take(own[BLOCK:]) + self.column.take(next_))
        return np.array([found[s : s + n].sum(dtype=np.float64) for s, n in zip(starts.tolist(), lengths.tolist())]) / np.log(10)
