"""Token ids in wavelet-matrix files: one compressed file per shard of consecutive documents.

A file holds the ids of its documents as bit-planes, highest bit first; every plane stores the ids' bits after a
stable partition by the plane before. With counts of ones per 512 bits, a reader gets any token, the number of
occurrences of an id in a range, and the place of its k-th occurrence without unpacking the rest.

Layout (little-endian): magic ``WMX1``; planes u32, documents u64, tokens u64; then sections, each a u64 length and a
zstd frame: document ids i64, flags for null ids u8, tokens per document u64, zeros per plane u64, and per plane its
bits as u64 words followed by its ones before each 512-bit block as u32.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from marketprose.llm.common import (
    as_key,
    dealt,
    filesystem,
    frames,
    keyed,
    new_folder,
    ordered_buckets,
    put_file,
    walked,
)
from marketprose.llm.pretokens import ByteCache, pieces
from marketprose.session import written

MAGIC = b"WMX1"
BLOCK_WORDS = 8


class WaveletMatrix:
    """Rank, select and access over a sequence of unsigned ids."""

    def __init__(self, size: int, zeros: np.ndarray, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.size, self.zeros, self.planes, self.ones = size, zeros, planes, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max(initial=0)).bit_length())
        planes, ones, zeros = [], [], []
        level = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        blocks = len(ids) // (64 * BLOCK_WORDS) + 1
        for shift in range(depth - 1, -1, -1):
            bits = (level & level.dtype.type(1 << shift)).astype(bool)
            packed = np.zeros(blocks * BLOCK_WORDS * 8, np.uint8)
            packed[: (len(ids) + 7) // 8] = np.packbits(bits, bitorder="little")
            plane = packed.view("<u8")
            counts = np.bitwise_count(plane).reshape(blocks, BLOCK_WORDS).sum(1, dtype=np.uint32)
            planes.append(plane)
            ones.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            count = int(ones[-1][-1])
            zeros.append(len(ids) - count)
            # a mask is the faster of the two where nearly all bits are alike
            if 8 * min(count, len(ids) - count) < len(ids):
                level = np.concatenate([level[~bits], level[bits]])
            else:
                level = np.concatenate([np.compress(~bits, level), np.compress(bits, level)])
        return cls(len(ids), np.array(zeros, "<u8"), planes, ones)

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each position."""
        plane, word = self.planes[k], at >> 6
        total = self.ones[k][at >> 9].astype(np.int64)
        for j in range(BLOCK_WORDS):
            w = (at >> 9) * BLOCK_WORDS + j
            total += np.where(w < word, np.bitwise_count(plane[w]), 0)
        inside = np.minimum(word, len(plane) - 1)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return total + np.bitwise_count(plane[inside] & mask)

    def access(self, positions) -> np.ndarray:
        """Ids at the positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64))
        value = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            bit = self._bit(k, at).astype(np.int64)
            before = self._ones(k, at)
            value = (value << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit == 1, int(self.zeros[k]) + before, at - before)
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        depth = len(self.planes)
        if value >> depth:
            return 0, 0
        for k in range(depth):
            before = self._ones(k, np.array([lo, hi]))
            if value >> (depth - 1 - k) & 1:
                lo, hi = (int(self.zeros[k]) + before).tolist()
            else:
                lo, hi = lo - int(before[0]), hi - int(before[1])
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` in [lo, hi)."""
        lo, hi = self._range(value, lo, self.size if hi is None else hi)
        return hi - lo

    def select(self, value: int, nth: int) -> int:
        """Position of the occurrence number ``nth`` (from 0) of ``value``; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.size)
        if not 0 <= nth < hi - lo:
            return -1
        at = lo + nth
        depth = len(self.planes)
        for k in range(depth - 1, -1, -1):
            one = value >> (depth - 1 - k) & 1
            wanted = at - int(self.zeros[k]) if one else at
            left, right = 0, self.size  # smallest end of a prefix that holds wanted + 1 such bits
            while left < right:
                mid = (left + right) // 2
                ones = int(self._ones(k, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > wanted:
                    right = mid
                else:
                    left = mid + 1
            at = left
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def unpack(self) -> np.ndarray:
        """All ids in order: planes undone from the lowest to the highest."""
        depth = len(self.planes)
        kind = np.uint16 if depth <= 16 else np.uint32
        value = np.zeros(self.size, kind)
        for k in range(depth - 1, -1, -1):
            bits = np.unpackbits(self.planes[k].view(np.uint8), count=self.size, bitorder="little").view(bool)
            level = np.empty_like(value)
            level[~bits] = value[: int(self.zeros[k])]
            level[bits] = value[int(self.zeros[k]) :] | kind(1 << (depth - 1 - k))
            value = level
        return value.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of one shard."""
    matrix = WaveletMatrix.build(ids)
    sections = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.array(lengths, "<u8"),
        matrix.zeros,
        *[part for pair in zip(matrix.planes, matrix.ones, strict=True) for part in pair],
    ]
    press = zstandard.ZstdCompressor(level=1)  # planes hardly shrink further
    out = [MAGIC, struct.pack("<IQQ", len(matrix.planes), len(doc_ids), len(ids))]
    for section in sections:
        frame = press.compress(section.tobytes())
        out += [struct.pack("<Q", len(frame)), frame]
    return b"".join(out)


class Shard:
    """An opened file."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        planes, docs, tokens = struct.unpack_from("<IQQ", content, 4)
        at, sections, unpress = 24, [], zstandard.ZstdDecompressor()
        for _ in range(4 + 2 * planes):
            (length,) = struct.unpack_from("<Q", content, at)
            sections.append(unpress.decompress(content[at + 8 : at + 8 + length]))
            at += 8 + length
        null = np.frombuffer(sections[1], np.uint8)
        self.doc_ids = [None if n else int(d) for d, n in zip(np.frombuffer(sections[0], "<i8"), null, strict=True)]
        self.lengths = np.frombuffer(sections[2], "<u8").astype(np.int64)
        bits = [np.frombuffer(s, "<u8") for s in sections[4::2]]
        ones = [np.frombuffer(s, "<u4") for s in sections[5::2]]
        self.matrix = WaveletMatrix(tokens, np.frombuffer(sections[3], "<u8"), bits, ones)
        if len(self.doc_ids) != docs or int(self.lengths.sum()) != tokens:
            raise ValueError("damaged wavelet-matrix file")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, start inside the file and ids, in file order."""
        ids, start = self.matrix.unpack(), 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            yield doc, start, ids[start : start + n]
            start += n


def byte_signs() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class PieceEncoder:
    """Text to packed ids by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    Each distinct pre-token goes to the library's model once while it is remembered. Files whose pre-tokenizer is not
    the plain byte-level one, and texts that hold the string of an added token, go to the library whole.
    """

    def __init__(self, path: str, limit: int = 192 << 20):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.signs = byte_signs()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        rules = json.loads(self.library.to_str())
        step = rules["pre_tokenizer"] or {}
        plain = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True)
        self.plain = plain and rules["normalizer"] is None
        self.known = ByteCache(self._piece, limit)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # these stand for themselves, but the space
            signs = piece.replace(" ", self.signs[32])
        else:
            signs = piece.encode().decode("latin-1").translate(self.signs)
        return self._packed([t.id for t in self.model.tokenize(signs)])

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(a in text for a in self.added):
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.known.__getitem__, pieces(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and tokenizer file."""
    return PieceEncoder(path)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    shard_tokens: int = 1 << 22,
) -> DataFrame:
    """Encode every text, append ``end_id``, write shard files in ascending order of ``key``; returns the list of files.

    ``tokenizer`` is the path of a byte-level BPE file for the tokenizers library that every executor has. Null texts
    count as empty: only the end id. Rows with a null key come first; rows with equal keys follow their texts' order.
    A file ends with the document that brings it to ``shard_tokens`` ids or closes its bucket. No rows, no files.
    Columns of the list: bucket, part, path, docs, tokens. Files appear whole or not at all, and a task that runs
    again writes the same files again.
    """
    folder = folder or new_folder(docs.sparkSession, "wavelet")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = ordered_buckets(rows, "doc_id", leads=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        bucket, part, size = None, 0, 0

        def close() -> pd.DataFrame:
            nonlocal held, part, size
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            path = f"{folder}/{bucket:06d}-{part:05d}.wmx"
            put_file(path, pack_shard([d for d, _ in held], [len(b) // 4 for _, b in held], ids))
            row = pd.DataFrame({"bucket": [bucket], "part": [part], "path": [path], "docs": [len(held)], "tokens": [len(ids)]})
            held, part, size = [], part + 1, 0
            return row

        for of, found in frames(batches):
            if of != bucket:
                if held:
                    yield close()
                bucket, part = of, 0
            for doc, content in zip(found["doc_id"], found["text"], strict=True):
                packed = encode(content) + end
                held.append((None if doc is None else int(doc), packed))
                size += len(packed) // 4
                if size >= shard_tokens:
                    yield close()
        if held:
            yield close()

    rows = walked(placed, "doc_id", "text").select("bucket", as_key("doc_id").alias("doc_id"), "text")
    listed = rows.mapInPandas(run, "bucket int, part int, path string, docs bigint, tokens bigint")
    return written(listed, "wavelet-files")


def read_shards(files: DataFrame, ids: bool = True) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (packed).

    Without ``ids`` that column is null; the crc32 is always taken from the ids that were read.
    """
    per_bucket = files.groupBy("bucket").agg(F.sum("tokens").alias("n"))  # at most 10,000 rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    based = files.join(bases, "bucket").withColumn("base", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                store, local = filesystem(path)
                with store.open_input_file(local) as source:
                    shard = Shard(source.read())
                found = []
                for doc, start, tokens in shard.documents():
                    packed = tokens.astype("<u4").tobytes()
                    found.append((None if doc is None else str(doc), base + start, len(tokens), zlib.crc32(packed), packed if ids else None))
                yield pd.DataFrame(found, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    schema = "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    return keyed(dealt(based.select("path", "base"), "path").mapInPandas(run, schema))
