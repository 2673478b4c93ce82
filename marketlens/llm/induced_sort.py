"""External induced sorting of the suffixes of a shard, with common prefixes.

The text is a sequence of codes in which every 0 is a separator unlike any
other (a later one is smaller). Suffixes that begin a valley (smaller than both
neighbours) are sorted first: their substrings up to the next valley are named
in order, and the names, a text of less than half the length, are sorted in
turn by doubling. All other suffixes are induced from them, first those that
are larger than their successor (buckets ascending), then the smaller ones
(descending). Every bucket is a first-in, first-out queue whose entries arrive
in sorted order, which makes the queues together the priority queue of the
induction; a queue keeps its tail on disk beyond ``MEMORY`` entries. Entries
are (position, common prefix with the entry before), and both are induced: the
common prefix of two induced suffixes is one more than the least between their
sources. Common prefixes count up to ``depth``; suffixes that agree so far may
stand in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries that a queue holds in memory, and that are induced at once.
MEMORY, PIECE = 1 << 21, 1 << 17


class Queue:
    """Positions and common prefixes in order; what exceeds MEMORY is on disk."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.file, self.sizes, self.last = 0, None, [], -1

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.last = int(pos[-1])
        self.parts.append((pos, lcp))
        self.held += len(pos)
        if self.held > MEMORY:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for a, b in self.parts:
                self.file.write(a.astype(np.int64).tobytes())
                self.file.write(b.astype(np.int32).tobytes())
                self.sizes.append(len(a))
            self.parts, self.held = [], 0

    def take(self):
        """All entries in order, in pieces; the queue is empty afterwards."""
        parts, sizes, file = self.parts, self.sizes, self.file
        self.parts, self.held, self.sizes, self.file = [], 0, [], None
        if file is not None:
            file.seek(0)
            for n in sizes:
                yield from _pieces(np.frombuffer(file.read(8 * n), np.int64), np.frombuffer(file.read(4 * n), np.int32))
            file.close()
        if parts:
            yield from _pieces(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def __bool__(self):
        return bool(self.parts or self.sizes)


def _pieces(pos: np.ndarray, lcp: np.ndarray):
    for i in range(0, len(pos), PIECE):
        yield pos[i:i + PIECE], lcp[i:i + PIECE]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next one."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = 1  # the last separator is the smallest of all
    differs = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(differs[::-1])[::-1]] > 0


def common(text: np.ndarray, a: int, b: int, depth: int) -> int:
    if a < 0 or b < 0:
        return 0
    x, y = text[a:a + depth], text[b:b + depth]
    n = min(len(x), len(y))
    bad = (x[:n] != y[:n]) | (x[:n] == 0)
    return int(bad.argmax()) if bad.any() else n


def _refine(rank: np.ndarray, active: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Split the groups of equal rank by ``word`` (given for ``active``); the
    ranks count the smaller members. Returns those not alone in their group."""
    order = np.lexsort((word, rank[active]))
    r, w = rank[active][order], word[order]
    group = np.append(True, r[1:] != r[:-1])
    part = group.copy()
    part[1:] |= w[1:] != w[:-1]
    at = np.arange(len(order))
    new = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    rank[active[order]] = new
    alone = part & np.append(part[1:], True)
    return np.sort(active[order[~alone]])


def sorted_valleys(text: np.ndarray, smaller: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the valleys and their common prefixes."""
    n = len(text)
    valley = np.flatnonzero(smaller & np.append(False, ~smaller[:-1]))
    m = len(valley)
    size = np.append(valley[1:], valley[-1]) - valley + 1
    symbol = (text.astype(np.uint64) << np.uint64(1)) | smaller
    # names of the substrings up to the next valley, separators being unlike each other
    rank = np.full(m, int((text[valley] == 0).sum()), np.int64)
    zero = np.flatnonzero(text[valley] == 0)
    rank[zero] = np.arange(len(zero))[::-1]
    active, d = np.flatnonzero(text[valley] != 0), 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for j in range(4):
            at = valley[active] + d + j
            word = word << np.uint64(16) | np.where(d + j < size[active], symbol[np.minimum(at, n - 1)], 0)
        active = _refine(rank, active, word)
        d += 4
        # groups of which no member goes on are equal substrings
        goes = np.zeros(m, bool)
        goes[rank[active[size[active] > d]]] = True
        active = active[goes[rank[active]]]
    levels = [rank.astype(np.int32)]
    width = 1
    while 2 * width <= depth and len(levels) < 10:  # a valley follows another after two codes at least
        alone = np.bincount(rank, minlength=m)[rank] == 1
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        nxt = active + width
        _refine(rank, active, np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0).astype(np.uint64))
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.lexsort((np.arange(m), rank))
    a, b = order[:-1], order[1:]
    off = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = b + off < m
        ok &= a + off < m
        same = ok.copy()
        same[ok] = levels[k][(a + off)[ok]] == levels[k][(b + off)[ok]]
        off[same] += 1 << k
    x = valley[np.minimum(a + off, m - 1)] - valley[a]
    live = np.flatnonzero(x < depth)
    while len(live):
        p, q = valley[a[live]] + x[live], valley[b[live]] + x[live]
        ok = (p < n) & (q < n)
        p, q = np.minimum(p, n - 1), np.minimum(q, n - 1)
        live = live[ok & (text[p] == text[q]) & (text[p] != 0)]
        x[live] += 1
        live = live[x[live] < depth]
    return valley[order], np.append(0, np.minimum(x, depth)).astype(np.int32)


class _Least:
    """Least value of stretches of a short array."""

    def __init__(self, v: np.ndarray):
        self.table = [v]
        while (1 << len(self.table)) <= len(v):
            t, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-w], t[w:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of v[lo..hi], both included."""
        k = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), self.table[0].dtype)
        for level in np.unique(k):
            at = k == level
            t = self.table[level]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(level)) + 1])
        return out


def _induce(text, wanted, queues, pos, lcp, depth) -> None:
    """File the predecessors (of the wanted type) of a piece of the order."""
    before = pos - 1
    at = np.flatnonzero((pos > 0) & wanted[before])
    if not len(at):
        return
    code = text[before[at]]
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    value = np.zeros(len(at), np.int32)
    inner = np.flatnonzero(code[1:] == code[:-1]) + 1
    if len(inner):
        value[inner] = np.minimum(1 + _Least(lcp).between(at[inner - 1] + 1, at[inner]), depth)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        c = int(code[lo])
        if c == 0:
            continue
        q = queues.setdefault(c, Queue())
        new = before[at[lo:hi]]
        value[lo] = common(text, q.last, int(new[0]), depth)
        q.put(new, value[lo:hi])


def suffixes(text: np.ndarray, depth: int):
    """Yield (positions, common prefix with the suffix before) of all suffixes
    that do not begin with a separator, in pieces, bucket by bucket. Within a
    bucket first the suffixes larger than their successor ascend, then the
    others descend; a piece's first value compares with the piece before."""
    smaller = smaller_than_next(text)
    seeds, seed_lcp = sorted_valleys(text, smaller, depth)
    cut = np.searchsorted(text[seeds], np.arange(258))
    larger, done = {}, {}
    queues: dict[int, Queue] = {}
    for c in range(257):
        out, last = Queue(), -1
        while queues.get(c):  # entries of the own code are filed again behind
            for pos, lcp in queues[c].take():
                out.put(pos, lcp)
                _induce(text, ~smaller, queues, pos, lcp, depth)
        done[c] = out
        if cut[c] < cut[c + 1]:
            for pos, lcp in _pieces(seeds[cut[c]:cut[c + 1]], seed_lcp[cut[c]:cut[c + 1]]):
                _induce(text, ~smaller, queues, pos, lcp, depth)
    larger = done
    queues = {}
    for c in range(256, 0, -1):
        last, low = -1, []
        while queues.get(c):
            for pos, lcp in queues[c].take():
                low.append((pos, lcp))
                last = int(pos[-1])
                _induce(text, smaller, queues, pos, lcp, depth)
        high = list(larger[c].take())
        for i in range(len(high) - 1, -1, -1):  # descending: compare with the entry above
            pos, lcp = high[i]
            above = common(text, last, int(pos[-1]), depth)
            down = np.append(np.int32(above), lcp[:0:-1])
            last = int(pos[0])
            _induce(text, smaller, queues, pos[::-1], down, depth)
        yield c, high, low


def repeated(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position whether another suffix shares its first ``depth`` codes."""
    out = np.zeros(len(text), bool)
    for _, high, low in suffixes(text, depth):
        last = -1
        for pos, lcp in high + [(p, x) for p, x in low]:
            full = lcp >= depth
            full[:1] = common(text, last, int(pos[0]), depth) >= depth
            out[pos[full]] = True
            out[pos[:-1][full[1:]]] = True
            if full[0]:
                out[last] = True
            last = int(pos[-1])
        if high and low:  # the largest of the one kind and the smallest of the other
            a, b = int(high[-1][0][-1]), int(low[-1][0][-1])
            if common(text, a, b, depth) >= depth:
                out[[a, b]] = True
    return out
