"""An n-gram trie in Elias-Fano levels, stored as one file that is memory-mapped.

Level 1 holds contexts (hashes) as a monotone sequence; monotone pointers give each context its range of successors;
level 2 holds the successors, each as its rank among the words of the file, made monotone by adding the context's
number times the number of words, so that a search starts and ends inside its context. Probabilities are 16-bit codes
on a logarithmic scale.

File: a JSON line with the arrays' names, types and places, then the arrays.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

LOWEST = -12.0  # log10 of the smallest probability that has a code
STEPS = 65534


def to_code(probability: np.ndarray) -> np.ndarray:
    """16-bit codes; 0 stands for a probability of zero."""
    p = np.asarray(probability, float)
    with np.errstate(divide="ignore"):
        code = 1 + np.rint((np.log10(p) / -LOWEST + 1) * STEPS)
    return np.where(p > 0, np.clip(code, 1, STEPS + 1), 0).astype("<u2")


def from_code(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


_VALUES = np.concatenate([[0.0], 10 ** (LOWEST * (1 - np.arange(STEPS + 1) / STEPS))])


class EliasFano:
    """A sorted sequence of unsigned 64-bit numbers: low bytes as they are, the rest in unary."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray):
        self.size, self.width, self.low, self.high = size, width, low, high
        # where each value of the high part begins, from the positions of the zeros
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        self.starts = (zeros - np.arange(len(zeros))).astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Bytes of a low part, low parts, and bits of the high parts: for each value of it a zero, then its ones."""
        n = len(values)
        largest = int(values[-1]) if n else 0
        # whole bytes, and as many as leave about one high part per value or fewer
        width = next(w for w in range(9) if largest >> (8 * w) <= 2 * n)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].copy()
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 2, np.uint8)
        bits[high + np.arange(n) + 1] = 1
        pad = -len(bits) % 8
        return width, low, np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]), bitorder="little")

    def _low(self, at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.width] = self.low[at]
        return wide.view("<u8").ravel()

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        if self.width == 8:
            return self._low(at)
        high = np.searchsorted(self.starts, at, "right") - 1
        return (high.astype(np.uint64) << np.uint64(8 * self.width)) | self._low(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Position of the first number that is at least the value; ``size`` if there is none."""
        values = values.astype(np.uint64)
        high = values >> np.uint64(8 * self.width) if self.width < 8 else np.zeros(len(values), np.uint64)
        high = np.minimum(high, np.uint64(len(self.starts))).astype(np.int64)
        bounds = np.concatenate([self.starts, [self.size, self.size]])
        lo, hi = bounds[high], bounds[np.minimum(high + 1, len(self.starts))]
        if not self.width:
            return lo
        low = values & np.uint64((1 << (8 * self.width)) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            less = self._low(mid) < low[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        return lo

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 if it is not in the sequence."""
        if not self.size:
            return np.full(len(values), -1, np.int64)
        at = self.successor(values)
        inside = np.minimum(at, self.size - 1)
        return np.where((at < self.size) & (self.access(inside) == values), inside, -1)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4 (index 0 unused)."""
    n = [float((counts == k).sum()) for k in range(5)]
    out = np.array([0.0, 0.75, 0.75, 0.75])
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k] and n[k + 1]:
                out[k] = k - (k + 1) * y * n[k + 1] / n[k]
            elif k > 1:
                out[k] = out[k - 1]
    # never nothing: a context must leave some weight to words not seen after it
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 0.99, 1.9, 2.9])


@dataclass
class Trie:
    """The contexts of one shard with their successors."""

    contexts: EliasFano
    pointers: EliasFano
    words: EliasFano
    successors: EliasFano
    alpha: np.ndarray  # code of the discounted probability of each successor
    gamma: np.ndarray  # code of the weight of the shorter context
    counts: np.ndarray  # occurrences of each context as a word

    def lookup(self, contexts: np.ndarray) -> np.ndarray:
        """Number of each context, -1 if unknown."""
        return self.contexts.find(contexts)

    def search(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Code of the probability of each word after its context (a number); 0 if it was not seen there."""
        rank = self.words.find(words)
        use = np.flatnonzero((context >= 0) & (rank >= 0))
        out = np.zeros(len(context), "<u2")
        number = context[use].astype(np.uint64)
        value = number * np.uint64(max(1, self.words.size)) + rank[use].astype(np.uint64)
        at = self.successors.find(value)
        inside = (at >= self.pointers.access(number).astype(np.int64)) & (at < self.pointers.access(number + np.uint64(1)).astype(np.int64))
        out[use[inside]] = self.alpha[at[inside]]
        return out


def build(
    contexts: np.ndarray, seen: np.ndarray, pair_context: np.ndarray, pair_word: np.ndarray, counts: np.ndarray, totals: np.ndarray
) -> bytes:
    """The file of a shard.

    ``contexts``: sorted hashes; ``seen``: their occurrences; pairs sorted by context number and word, with their
    counts; ``totals``: occurrences of each context with any successor, here or in other shards.
    """
    discount = discounts(counts)[np.minimum(counts, 3)]
    total = np.maximum(totals, 1)
    alpha = (counts - discount) / total[pair_context]
    gamma = np.bincount(pair_context, discount, len(contexts)) / total
    words, rank = np.unique(pair_word, return_inverse=True)
    values = pair_context.astype(np.uint64) * np.uint64(max(1, len(words))) + rank.astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair_context, minlength=len(contexts)))])
    arrays: dict[str, np.ndarray] = {}
    meta: dict[str, list[int]] = {}
    sequences = {"contexts": contexts, "pointers": ends.astype(np.uint64), "words": words.astype(np.uint64), "successors": values}
    for name, sequence in sequences.items():
        width, low, high = EliasFano.encode(sequence)
        meta[name] = [len(sequence), width]
        arrays |= {f"{name}.low": low, f"{name}.high": high}
    arrays |= {"alpha": to_code(alpha), "gamma": to_code(gamma), "counts": seen.astype("<u4")}
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = [array.dtype.str, list(array.shape), at]
        at += array.nbytes + -array.nbytes % 8
    head = json.dumps({"sequences": meta, "arrays": places}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return b"".join([head, *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values())])


def opened(content: np.ndarray) -> Trie:
    """A trie over the bytes of its file, for example a memory map."""
    line = bytes(content[: 1 << 20]).partition(b"\n")[0]
    head, start = json.loads(line), len(line) + 1

    def array(name: str) -> np.ndarray:
        kind, shape, at = head["arrays"][name]
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        return content[start + at : start + at + size].view(kind).reshape(shape)

    def sequence(name: str) -> EliasFano:
        return EliasFano(*head["sequences"][name], array(f"{name}.low"), array(f"{name}.high"))

    names = ("contexts", "pointers", "words", "successors")
    return Trie(*map(sequence, names), array("alpha"), array("gamma"), array("counts"))
