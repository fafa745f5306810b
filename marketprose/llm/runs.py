"""Runs: maximal stretches of words that repeat with a period, found through suffix trees.

A run has a root that is a Lyndon word under the order of the words or under the reverse order, and the longest Lyndon
word that starts at a place ends where the next smaller suffix starts. So every place gives two candidates for a period,
and each is extended to the right and to the left as far as the period holds. Right extensions are longest common
prefixes of two suffixes: string depths of lowest common ancestors in the suffix tree of the document; left extensions
are the same in the tree of the reversal. Trees are built by Ukkonen's algorithm; an Euler tour with block minima answers
ancestor queries in constant time, for all candidates of a document together.

Only stretches in which a long run can lie come to the trees: a run of at least three periods holds each of its words
three times, so a stretch is cut at words it holds less often, again and again, and forgotten when shorter than the
least length. No run that is asked for crosses such a cut, nor does its extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 32


class SuffixTree:
    """Ukkonen's tree of a sequence of symbols 1, 2, ... with the end mark 0 behind it.

    ``edges`` has one row per node but the root, sorted by (parent, first symbol): ``parent``, ``child``, ``length``.
    """

    def __init__(self, symbols: np.ndarray):
        text = [*symbols.tolist(), 0]
        n, wide = len(text), int(symbols.max(initial=0)) + 1
        self.size = n
        first, last, link = [0], [0], [0]  # a node's incoming edge is text[first:last]; leaves end at n
        child: dict[int, int] = {}  # node * wide + first symbol
        find = child.get
        node = edge = length = pending = 0
        for i in range(n):
            symbol, above, pending = text[i], 0, pending + 1
            while pending:
                if not length:
                    edge = i
                key = node * wide + text[edge]
                down = find(key)
                if down is None:
                    child[key] = len(first)
                    first.append(i), last.append(n), link.append(0)
                    if above:
                        link[above] = node
                    above = 0
                else:
                    span = min(last[down], i + 1) - first[down]
                    if length >= span:
                        node, edge, length = down, edge + span, length - span
                        continue
                    start = first[down]
                    if text[start + length] == symbol:
                        if above and node:
                            link[above] = node
                        length += 1
                        break
                    middle = len(first)
                    first.append(start), last.append(start + length), link.append(0)
                    child[key] = middle
                    child[middle * wide + symbol] = middle + 1
                    first.append(i), last.append(n), link.append(0)
                    first[down] = start + length
                    child[middle * wide + text[start + length]] = down
                    if above:
                        link[above] = middle
                    above = middle
                pending -= 1
                if not node and length:
                    length -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        parent, self.symbol = np.divmod(keys[order], wide)
        self.child = nodes[order]
        self.length = (np.array(last, np.int64) - np.array(first, np.int64))[self.child]
        self.first_edge = np.searchsorted(parent, np.arange(len(first) + 1))

    def _children(self, turned: bool) -> tuple[list[int], list[int], list[int]]:
        """Bounds of every node's edges, children and edge lengths; turned: symbols descend, but the end mark stays first."""
        child, length = self.child, self.length
        if turned:
            parent = np.repeat(np.arange(len(self.first_edge) - 1), np.diff(self.first_edge))
            order = np.lexsort((np.where(self.symbol == 0, -(1 << 62), -self.symbol), parent))
            child, length = child[order], length[order]
        return self.first_edge.tolist(), child.tolist(), length.tolist()

    def ranks(self, turned: bool = False) -> np.ndarray:
        """Rank of every suffix that is not empty, under the symbols' order or the reverse one."""
        bounds, child, length = self._children(turned)
        out, n = [], self.size
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            lo, hi = bounds[node], bounds[node + 1]
            if lo == hi:
                out.append(n - depth)
            else:
                stack.extend((child[e], depth + length[e]) for e in range(hi - 1, lo - 1, -1))
        rank = np.empty(n, np.int64)
        rank[out] = np.arange(n)
        return rank[: n - 1]

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and where the tour visits the leaf of each suffix."""
        bounds, child, length = self._children(False)
        n = self.size
        depths, leaf = [], [0] * n
        stack, deep = [0], [0]  # a node to enter, or -1 to come back to the node of that depth
        while stack:
            node, depth = stack.pop(), deep.pop()
            if node >= 0:
                lo, hi = bounds[node], bounds[node + 1]
                if lo == hi:
                    leaf[n - depth] = len(depths)
                else:
                    for e in range(hi - 1, lo - 1, -1):
                        stack.append(-1)
                        deep.append(depth)
                        stack.append(child[e])
                        deep.append(depth + length[e])
            depths.append(depth)
        return np.array(depths, np.int64), np.array(leaf, np.int64)


class Ancestors:
    """Length of the longest common prefix of two suffixes: the least depth of the tour between their leaves."""

    def __init__(self, tree: SuffixTree):
        depths, self.leaf = tree.tour()
        blocks = -(-len(depths) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(depths)] = depths
        grid = padded.reshape(blocks, BLOCK)
        self.flat = padded
        self.upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [grid.min(axis=1)]
        step = 1
        while 2 * step <= blocks:
            low = self.table[-1]
            self.table.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different suffixes."""
        a, b = self.leaf[i], self.leaf[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.onward[a], self.upto[b])
        near = np.flatnonzero(first == last)
        if len(near):
            lo, hi = a[near], b[near]
            least = self.flat[lo]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.flat[np.minimum(lo + k, hi)])
            out[near] = least
        far = np.flatnonzero(last - first > 1)
        if len(far):
            lo, hi = first[far] + 1, last[far]  # whole blocks [lo, hi)
            level = np.frexp((hi - lo).astype(float))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                mine = level == k
                row = self.table[k]
                least[mine] = np.minimum(row[lo[mine]], row[hi[mine] - (1 << int(k))])
            out[far] = np.minimum(out[far], least)
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place the next one of lower rank, or the end."""
    out, stack = [0] * len(rank), []
    values = rank.tolist()
    for i in range(len(values) - 1, -1, -1):
        value = values[i]
        while stack and values[stack[-1]] > value:
            stack.pop()
        out[i] = stack[-1] if stack else len(values)
        stack.append(i)
    return np.array(out, np.int64)


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """All runs of a sequence, rows (start, length, period) with length >= 2 * period, by start, then period."""
    n = len(symbols)
    if n < 2:
        return np.empty((0, 3), np.int64)
    dense = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    forward = SuffixTree(dense)
    lyndon = [next_smaller(forward.ranks(turned)) for turned in (False, True)]
    right = Ancestors(forward)
    del forward
    left = Ancestors(SuffixTree(dense[::-1]))
    i = np.concatenate([np.arange(n), np.arange(n)])
    j = np.concatenate(lyndon)
    pairs = np.unique(np.stack([i, j], axis=1), axis=0)
    i, j = pairs[:, 0], pairs[:, 1]
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    inside = np.flatnonzero(j < n)
    ahead[inside] = right.common(i[inside], j[inside])
    known = np.flatnonzero(i > 0)
    behind[known] = left.common(n - i[known], n - j[known])  # what ends before i and before j
    start, end, period = i - behind, j + ahead, j - i
    long = end - start >= 2 * period
    return np.unique(np.stack([start[long], (end - start)[long], period[long]], axis=1), axis=0)


def stretches(symbols: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more in which every word occurs ``times`` times or more."""
    out, waiting = [], [(0, len(symbols))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < least:
            continue
        part = symbols[lo:hi]
        if int(part.max()) < 8 * len(part):
            rare = np.bincount(part)[part] < times
        else:
            _, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
            rare = counts[inverse] < times
        cut = np.flatnonzero(rare)
        if not len(cut):
            out.append((lo, hi))
            continue
        bounds = np.concatenate([[-1], cut, [hi - lo]])
        kept = np.flatnonzero(np.diff(bounds) > least)  # a gap of d holds d - 1 words
        waiting += [(lo + int(bounds[k]) + 1, lo + int(bounds[k + 1])) for k in kept]
    return sorted(out)


def long_runs(symbols: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Runs of at least ``least`` words and ``times`` periods: rows (start, length, period), by start, then period."""
    found = [np.empty((0, 3), np.int64)]
    for lo, hi in stretches(symbols, least, times):
        runs = all_runs(symbols[lo:hi])
        runs[:, 0] += lo
        found.append(runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])])
    return np.concatenate(found)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that no run repeats: those in no run, or in the first period of every run that has them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


Edit = Callable[[int | None, int], tuple[int, int] | None]

RUNS = (
    "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best int, collapsed string"
)


def collapse_runs(
    docs: DataFrame, least: int = 24, times: int = 3, edit: Edit | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, runs (start and length in words, period; by start, then period), best (place in ``runs`` of
    the one with most periods, the first of equals; null without runs), collapsed (the words that no run repeats, joined
    by one space).

    Words are ``[^\\x20\\x09-\\x0D]+`` and are compared exactly. Null texts have no words. ``times`` is 3 or more. ``edit`` may
    plant a repetition: for the id and the number n > 0 of words it gives (a, p) with a < n, and every word i >= a becomes
    word a + (i - a) % p. Rows are independent of each other, so repeated rows and ids give a row each; ids may be null.
    Other columns are not read. A task holds one document's trees at a time, in space linear in its stretches.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have at least three periods and a word")
    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def one(doc: int | None, content: str) -> tuple[int, list[dict], int | None, bytes]:
        found = content.encode().split()
        n = len(found)
        places = edit(doc, n) if edit and n else None
        if n < least:
            source = found
            if places:
                a, p = places
                source = [found[i if i < a else a + (i - a) % p] for i in range(n)]
            return n, [], None, b" ".join(source)
        number: dict[bytes, int] = {}
        symbols = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, n)
        at = None
        if places:
            a, p = places
            at = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
            symbols = symbols[at]
        runs = long_runs(symbols, least, times)
        if not len(runs):
            return n, [], None, b" ".join(found if at is None else map(found.__getitem__, at.tolist()))
        rows = runs.tolist()
        best = 0
        for k, (_, length, period) in enumerate(rows):  # by start, then period: the first of equals stays
            if length * rows[best][2] > rows[best][1] * period:
                best = k
        keep = kept_words(n, runs)
        keep = keep if at is None else at[keep]
        listed = [{"start": s, "length": m, "period": q} for s, m, q in rows]
        return n, listed, best, b" ".join(map(found.__getitem__, keep.tolist()))

    runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids = batch.column(0)
                rows = [one(ids[i].as_py(), batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], runs_type),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    return chosen.mapInArrow(run, f"doc_id bigint, {RUNS}")
