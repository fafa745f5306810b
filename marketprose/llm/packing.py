"""Packing documents into windows of bounded length, in order, by dynamic programming over cut positions.

The ids of consecutive documents form one stream. A window is a slice of it. Cuts may stand at ends of documents (free),
at ends of sentences, and, where a sentence is long, every few ids inside it, the last two at a price, since they truncate
a document or a sentence. A window pays for its padding, too: what it lacks to the full length, or nothing if its
length is a power of two. The cheapest list of cuts comes from one pass over the positions: the best window that is
padded to the full length is the head of a monotone queue of (cost + position), the unpadded ones are looked up by
their few lengths.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketprose.llm.common import ordered_buckets, walked
from marketprose.llm.wavelet import byte_signs, encoder

WINDOW = 1024


def positions(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, prices: tuple[float, float], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, ascending from 0 to its end, and what each cut costs.

    ``ends``: the stream's positions after each document; ``closes``: per id whether a sentence ends after it.
    """
    free = np.unique(np.concatenate([[0], ends]))
    natural = np.union1d(free, np.flatnonzero(closes[ids]) + 1)
    steps = np.diff(natural)
    long = np.flatnonzero(steps > gap)
    inner = (steps[long] - 1) // gap  # cuts inside a long stretch, ``gap`` ids apart
    within = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    forced = np.repeat(natural[long], inner) + within * gap
    at = np.concatenate([natural, forced])
    cost = np.concatenate([np.full(len(natural), prices[0]), np.full(len(forced), prices[1])])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    cost[np.searchsorted(at, free)] = 0.0
    return at, cost


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW, per_window: float = 1.0) -> tuple[list[int], float]:
    """Indexes into ``at`` of the cheapest cuts, the first and the last position included, and what they cost.

    Neighbouring positions are at most ``window`` apart. Of equally cheap lists the one of longer windows is taken.
    """
    short = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    hits = []  # (position, where an unpadded window that ends there starts)
    for length in short:
        found = np.searchsorted(at, at - length)
        j = np.flatnonzero(at[found] == at - length)
        hits.append(np.stack([j, found[j]], axis=1))
    pairs = np.concatenate(hits) if hits else np.empty((0, 2), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    to, start = pairs[:, 0].tolist() + [len(at)], pairs[:, 1].tolist()
    place, price = at.tolist(), cost.tolist()
    best, came = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost + position, index): costs rise, the head is the cheapest
    hit = 0
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0][1]] < here - window:
            queue.popleft()
        least, origin = queue[0]
        least += window - here
        while to[hit] == j:
            i = start[hit]
            if best[i] < least:
                least, origin = best[i], i
            hit += 1
        best[j] = least = least + price[j] + per_window
        came[j] = origin
        reach = least + here
        while queue and queue[-1][0] > reach:
            queue.pop()
        queue.append((reach, j))
    chosen = [len(place) - 1]
    while chosen[-1]:
        chosen.append(came[chosen[-1]])
    return chosen[::-1], best[-1]


@functools.lru_cache(maxsize=2)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """Per id whether its text ends a sentence: a full stop, question or exclamation mark, perhaps with closing quotes or
    brackets behind it, or a line break."""
    library = encoder(tokenizer).library
    plain = {sign: chr(byte) for byte, sign in byte_signs().items()}
    out = np.zeros(max(library.get_vocab_size(), 1), bool)
    for token, number in library.get_vocab().items():
        text = "".join(plain.get(c, c) for c in token).rstrip("\"')]")
        out[number] = text.endswith((".", "!", "?", "\n"))
    return out


PIECES = "doc_id bigint, row long, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Chain:
    """Documents gathered until their stream is long enough to be cut."""

    def __init__(self, closes: np.ndarray, window: int, prices: tuple[float, float], gap: int):
        self.closes, self.window, self.prices, self.gap = closes, window, prices, gap
        self.begin(0)

    def begin(self, bucket: int) -> None:
        self.bucket, self.windows = bucket, 0
        self.clear()

    def clear(self) -> None:
        self.keys: list[int | None] = []
        self.rows: list[int] = []
        self.packed: list[bytes] = []
        self.size = 0

    def add(self, key: int | None, row: int, packed: bytes) -> None:
        self.keys.append(key)
        self.rows.append(row)
        self.packed.append(packed)
        self.size += len(packed) // 4

    def close(self, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        """The pieces of the windows that the stream is cut into, ``most`` ids or a little more per batch."""
        if not self.size:
            return
        content = b"".join(self.packed)
        ids = np.frombuffer(content, "<u4")
        sizes = np.array([len(p) // 4 for p in self.packed], np.int64)
        ends = np.cumsum(sizes)
        at, cost = positions(ids, ends, self.closes, self.prices, self.gap)
        windows = at[cuts(at, cost, self.window)[0]]
        bounds = np.union1d(windows, ends)  # no document is empty, each has its end id
        begin, end = bounds[:-1], bounds[1:]
        of = np.searchsorted(ends, begin, side="right")
        number = np.searchsorted(windows, begin, side="right") - 1
        keys, rows = pa.array(self.keys, pa.int64()), pa.array(self.rows, pa.int64())
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + most, side="right")))
            offsets = ((bounds[lo : hi + 1] - begin[lo]) * 4).astype(np.int32)
            data = pa.py_buffer(content[4 * int(begin[lo]) : 4 * int(end[hi - 1])])
            doc = of[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(doc)),
                    rows.take(pa.array(doc)),
                    pa.array(begin[lo:hi] - (ends - sizes)[doc]),
                    pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), data]),
                    pa.array(sizes[doc]),
                    pa.array((self.bucket << 32) + self.windows + number[lo:hi]),
                    pa.array(begin[lo:hi] - windows[number[lo:hi]]),
                ],
                names=["doc_id", "row", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            lo = hi
        self.windows += len(windows) - 1
        self.clear()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    window: int = WINDOW,
    sentence_price: float = 2.0,
    inside_price: float = 8.0,
    gap: int = 64,
    chain_tokens: int = 1 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` ids: per piece doc_id, row (numbers the rows of a bucket), start
    (the document's ids before it), ids (packed little-endian u32), doc_tokens, sequence_id, offset (inside its window).

    Documents follow each other by ascending key, rows with equal keys by their texts; null keys come first and stay
    null, null texts count as empty. Every document is its ids by the tokenizer file with ``end_id`` behind them. A row is
    a document of its own, also when its key repeats. ``window`` is a power of two. Cutting a document after a sentence
    costs as much as ``sentence_price`` ids of padding, inside a stretch of over ``gap`` ids without a sentence's end
    ``inside_price``. Streams are cut independently of each other: one is closed with the document that brings it to
    ``chain_tokens`` ids or that ends its bucket, so a task holds that many ids, or one document if that is longer. Other
    columns are not read; without rows there are no pieces. A task that runs again gives the same windows again.
    """
    if window < 1 or window & (window - 1) or gap > window:
        raise ValueError("the window must be a power of two and no shorter than the gap")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = ordered_buckets(rows, "doc_id", leads=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        chain = Chain(sentence_ends(tokenizer), window, (sentence_price, inside_price), gap)
        row = 0
        for batch in batches:
            names = batch.schema.names
            at = [batch.column(names.index(c)) for c in ("bucket", "doc_id", "text")]
            for i in range(batch.num_rows):
                bucket = at[0][i].as_py()
                if bucket != chain.bucket:
                    yield from chain.close()
                    chain.begin(bucket)
                    row = 0
                chain.add(at[1][i].as_py(), row, encode(at[2][i].as_py()) + end)
                row += 1
                if chain.size >= chain_tokens:
                    yield from chain.close()
        yield from chain.close()

    return walked(placed, "doc_id", "text").mapInArrow(run, PIECES)
