"""Byte-level BPE by ranks: pairs wait in one bucket per rank, a bitmap over the ranks finds the next bucket.

The vocabulary comes from a rank file (base64 bytes and a rank per line). A pre-token is encoded as the public
reference library does it: whole if the vocabulary has it, otherwise the adjacent pair of lowest rank is merged, the
leftmost first, until no pair is in the vocabulary. Text of n bytes takes O(n log n) steps also when it has no word
boundary at all.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketprose.llm.pretokens import ByteCache, splitter


class RankQueue:
    """Positions waiting under a rank; the lowest rank comes first, and of one rank the leftmost position.

    Two bitmap levels hold one bit per rank and one bit per group of ranks that has any: the next rank is found by
    two find-first-set steps. Entries are never removed from the middle; whoever takes one tests if it still holds.
    """

    BITS = [1 << k for k in range(256)]

    def __init__(self, size: int):
        self.leaves = [0] * (size // 256 + 1)
        self.groups = 0
        self.buckets: list[list[int] | None] = [None] * (size + 1)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [position]
            self.leaves[rank >> 8] |= self.BITS[rank & 255]
            self.groups |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """Lowest rank and its leftmost position; (-1, -1) if nothing waits."""
        groups = self.groups
        if not groups:
            return -1, -1
        group = (groups & -groups).bit_length() - 1
        leaf = self.leaves[group]
        low = leaf & -leaf
        rank = (group << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self.buckets[rank] = None
        self.leaves[group] = leaf = leaf ^ low
        if not leaf:
            self.groups = groups & (groups - 1)
        return rank, bucket[0]


class Codec:
    """Encodes text to the ids of a rank table and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.pieces = splitter(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]  # rank of every pair of bytes
        self.known = ByteCache(self._piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of, push, pop = self.ranks.get, self.queue.push, self.queue.pop
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # start of the next part; the parts are a linked list over byte positions
        before = list(range(-1, n - 1))
        # rank of the part at this position joined with the next one, -1 if none
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if pair[i] != rank:
                continue  # stale: one of the two parts has been merged since
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i : after[end]], -1)
                if rank >= 0:
                    push(rank, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = rank = rank_of(piece[left:end], -1)
                if rank >= 0:
                    push(rank, left)
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(rank_of(piece[i:end]))
            i = end
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes the ids stand for; a KeyError for an id that is not in the vocabulary."""
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of batches, so that a task holds the results of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fields(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [f"`{c}` {t}" for c, t in df.select(*columns).dtypes]


def encode_texts(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per row: the columns of ``keep`` and ``ids``, the text's ids packed as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file that every executor has. Null texts count as empty and give no ids. Rows are
    independent of each other, so repeated rows give equal results. Other columns are not read.
    """
    chosen = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = codec(ranks, pattern).packed
        for batch in _slices(batches):
            *kept, texts = batch.columns
            ids = pa.array([packed(t) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, ids], names=[*batch.schema.names[:-1], "ids"])

    return chosen.mapInArrow(run, ", ".join([*_fields(docs, keep), "ids binary"]))


def decode_ids(
    encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per row: the columns of ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded`` (bytes) and ``decoded_sha256``."""
    added = ["n_tokens bigint", "ids_sha256 string", "decoded binary", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks, pattern).decode
        for batch in _slices(batches):
            *kept, packed = batch.columns
            packed = packed.to_pylist()
            decoded = [decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            found = [
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array(decoded, pa.binary()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            names = [*batch.schema.names[:-1], *(f.split()[0] for f in added)]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=names)

    return encoded.select(*keep, ids).mapInArrow(run, ", ".join([*_fields(encoded, keep), *added]))
