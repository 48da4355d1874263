"""Periodic runs of words: suffix trees, constant-time longest common extensions, Lyndon roots.

A run is a longest stretch of consecutive words with a smallest period q (words q
apart are identical) that no neighbouring word extends.  Every run holds a Lyndon
word of length q, in one of the two orders of the words, which is the longest one that starts
at its place.  So there are two candidates for each word: (place, length of the longest
Lyndon word there).  Each is extended to the right and to the left by longest common extensions: the
depth of the lowest common ancestor of two leaves, in Ukkonen's suffix tree of the words and in that
of the reversed words, read in constant time as a range minimum over the tree's Euler
tour.  Runs of at least ``exponent`` periods and ``least`` words are returned.

Trees stand over stretches only: a run of four periods and six words consists of
4-word windows that each occur twice in it, so a word in no window that occurs twice can't
be part of one.  Such words cut a document, and the pieces again, until nothing changes;
what is left (little, in prose) holds every run whole.  Windows are compared by a 64-bit
hash there; equal hashes of different windows only leave more for the trees, which compare words.

Work and memory follow one text at a time; nothing is shuffled.

Defined cases: a null text, an empty one and one of spaces have no words, no runs and an
empty collapsed text; rows that repeat get the same result each; ids may be null; an empty
table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import U64, column, raw

EXPONENT = 4
LEAST = 6
#: words of a window whose second occurrence a run of EXPONENT periods and LEAST words needs
GRAM = 4
#: neighbours in one block of a range minimum
BLOCK = 16
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class SuffixTree:
    """Ukkonen's tree of a list of positive numbers, with 0 put after its end.

    ``tour``: the nodes in Euler order, children by ascending number.  ``depth``: string depth of each node.
    """

    def __init__(self, numbers: list[int]):
        self.numbers = [*numbers, 0]
        self.size = len(self.numbers)
        self.base = max(self.numbers) + 1
        self._build()
        self._walk()

    def _build(self) -> None:
        s, n, base = self.numbers, self.size, self.base
        start, stop, link, to = [0], [0], [0], {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            waits = 0
            while left:
                if not length:
                    edge = i
                key = node * base + s[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                    waits = node
                else:
                    begin = start[child]
                    span = min(stop[child], i + 1) - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    mid = len(start)
                    start += [begin, i]
                    stop += [begin + length, n]
                    link += [0, 0]
                    to[key] = mid
                    to[mid * base + c] = mid + 1
                    start[child] = begin + length
                    to[mid * base + s[begin + length]] = child
                    if waits:
                        link[waits] = mid
                    waits = mid
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.start, self.stop, self.to = start, stop, to

    def _walk(self) -> None:
        m = len(self.start)
        keys, child = (np.fromiter(x, np.int64, m - 1) for x in (self.to.keys(), self.to.values()))
        del self.to
        parent, symbol = keys // self.base, keys % self.base
        by = np.lexsort((symbol, parent))
        self.children = child[by].tolist()
        self.ptr = np.searchsorted(parent[by], np.arange(m + 1)).tolist()
        self.terminal = np.zeros(m, bool)
        self.terminal[child[symbol == 0]] = True
        span = np.array(self.stop) - np.array(self.start)
        depth, spans, ptr, children, tour, stack = [0] * m, span.tolist(), self.ptr, self.children, [], [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(~v)
                continue
            tour.append(v)
            d = depth[v]
            for k in range(ptr[v + 1] - 1, ptr[v] - 1, -1):
                x = children[k]
                depth[x] = d + spans[x]
                stack += [~v, x]
        self.depth, self.tour = np.array(depth), np.array(tour)
        self.leaf = np.diff(self.ptr) == 0

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in the tour, suffix) of the leaves in ascending order of their suffixes."""
        at = np.flatnonzero(self.leaf[self.tour])
        return at, self.size - self.depth[self.tour[at]]

    def ranks(self, falling: bool = False) -> list[int]:
        """Rank of every suffix; ``falling``: in the order of falling numbers, where an end still comes first."""
        if not falling:
            order = self.leaves()[1]
        else:
            found, stack, ptr, children, terminal = [], [0], self.ptr, self.children, self.terminal
            while stack:
                v = stack.pop()
                lo, hi = ptr[v], ptr[v + 1]
                if lo == hi:
                    found.append(v)
                elif terminal[children[lo]]:
                    stack += children[lo + 1:hi]
                    stack.append(children[lo])
                else:
                    stack += children[lo:hi]
            order = self.size - self.depth[found]
        rank = np.empty(self.size, np.int64)
        rank[order] = np.arange(self.size)
        return rank.tolist()


class RangeMin:
    """Minima of many ranges at once, each in constant time: inside blocks by prefix and suffix minima, across blocks by a sparse table."""

    def __init__(self, values: np.ndarray):
        top = np.iinfo(values.dtype).max
        self.values = np.concatenate([values, np.full(-len(values) % BLOCK + BLOCK, top, values.dtype)])
        square = self.values.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(square, 1).ravel()
        self.behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [square.min(1)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            x, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(x[:-step], x[step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of values[min(a, b)] to values[max(a, b)], both included."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            f, n = first[inner] + 1, last[inner] - first[inner] - 1
            level = np.frexp(n)[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                at, t = inner[own], self.table[k]
                out[at] = np.minimum(out[at], np.minimum(t[f[own]], t[f[own] + n[own] - (1 << k)]))
        same = np.flatnonzero(first == last)
        if len(same):
            at = lo[same, None] + np.arange(BLOCK)
            out[same] = np.where(at <= hi[same, None], self.values[at], self.values[lo[same], None]).min(1)
        return out


class Extensions:
    """Length of the longest common beginning of two suffixes."""

    def __init__(self, tree: SuffixTree):
        at, suffix = tree.leaves()
        self.place = np.empty(tree.size, np.int64)
        self.place[suffix] = at
        self.least = RangeMin(tree.depth[tree.tour].astype(np.int32))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.least.of(self.place[i], self.place[j]).astype(np.int64)


def longest_lyndon(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at every place but the end: the distance to the next smaller suffix."""
    out, stack = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] - i if stack else 0
        stack.append(i)
    return np.array(out[:-1], np.int64)


def runs_of_numbers(numbers: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``exponent`` >= 2 periods and ``least`` numbers, in that order."""
    n = len(numbers)
    if n < max(2, least):
        return []
    tree = SuffixTree(numbers)
    periods = [longest_lyndon(tree.ranks(falling)) for falling in (False, True)]
    ahead = Extensions(tree)
    del tree
    back = Extensions(SuffixTree(numbers[::-1]))
    found = set()
    place = np.arange(n)
    for p in periods:
        end = place + ahead.of(place, place + p) + p
        start = place - back.of(n - place, n - place - p)
        good = end - start >= np.maximum(exponent * p, least)
        found.update(zip(start[good].tolist(), (end - start)[good].tolist(), p[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: list[bytes], start: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of the parts of a text that may hold runs of EXPONENT periods and LEAST words."""
    todo = [(start, words)]
    while todo:
        at, own = todo.pop()
        n = len(own)
        if n < LEAST:
            continue
        h = np.fromiter(map(hash, own), np.int64, n).view(U64)
        with np.errstate(over="ignore"):
            grams = sum((h[k:n - GRAM + 1 + k] * _ODD[k] for k in range(1, GRAM)), h[:n - GRAM + 1] * _ODD[0])
        by = np.argsort(grams)
        same = np.diff(grams[by]) == 0
        if not same.any():
            continue
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        steps = np.zeros(n + 1, np.int64)
        places = by[twice]
        steps[places] += 1
        steps[places + GRAM] -= 1
        turn = np.diff(np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8))
        parts = [(i, j) for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()) if j - i >= LEAST]
        if parts == [(0, n)]:
            yield at, own
        else:
            todo += [(at + i, own[i:j]) for i, j in parts]


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    found = []
    for at, own in stretches(words):
        known: dict[bytes, int] = {}
        found += [(at + s, n, p) for s, n, p in runs_of_numbers([known.setdefault(w, len(known) + 1) for w in own])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, runs, kept = [], [], []
        for text in raw(b):
            words = text.split()
            own = runs_of_words(words)
            n_words.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
            kept.append(b" ".join(collapsed(words, own)))
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
                                         names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start, then period) and the collapsed text of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
