"""Phrase collocations from sorted count streams: n-grams in prefix order and in suffix order, merge-joined in lockstep.

Counting sorts instead of hashing. Every word starts a window of the words that follow it inside its piece. A block of
text becomes a stream of its distinct windows in prefix order with their counts, a compressed chunk per half million.
Bounds between windows divide the order into parts, so that a very frequent word or pair spreads over as many parts as
its windows fill; chunks are cut at the bounds, and a part merges what all blocks have for it. In prefix order the windows
of an n-gram lie together: runs of equal first k words give the counts of all k-grams. An n-gram that a bound may cut is
passed on whatever its count, and its shares are added up.

The frequent n-grams are kept twice: as the prefix stream, keyed by all words but the last, and as the suffix stream,
keyed by all but the first. Sort-merge joins with the stream one word shorter give each n-gram the counts of its first
parts (left), of its rests (right), and the highest count of an n-gram one word longer (extension).
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from marketprose.llm.common import forget_recent
from marketprose.session import small_batches, written

BREAK = b"\xff"  # no part of UTF-8 text
_TABLE = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\v\f\r":
    _TABLE[_c] = 10
_TABLE = bytes(_TABLE)

Key = tuple[bytes, ...]


def marked_words(text: str) -> list[bytes]:
    """Words in lower case (A-Z only), with a break wherever a piece ends."""
    return text.encode().translate(_TABLE).replace(b"\n", b" \xff ").split()


class Numbers(dict):
    """Word to its number in order of appearance; the break is 0."""

    def __init__(self):
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Stream:
    """Distinct windows in prefix order. ``words`` are sorted; ``columns`` hold numbers from 1, 0 where a window has ended."""

    def __init__(self, words: list[bytes], columns: list[np.ndarray], counts: np.ndarray):
        self.words, self.columns, self.counts = words, columns, counts

    def __len__(self) -> int:
        return len(self.counts)

    def key(self, i: int) -> Key:
        return tuple(self.words[c[i] - 1] if c[i] else b"" for c in self.columns)

    def cut(self, lo: int, hi: int) -> Stream:
        """Windows [lo, hi) with a dictionary of their own."""
        columns = [c[lo:hi] for c in self.columns]
        used = np.zeros(len(self.words) + 1, bool)
        for c in columns:
            used[c] = True
        used[0] = False
        number = np.cumsum(used)
        number[0] = 0
        words = [self.words[i - 1] for i in np.flatnonzero(used).tolist()]
        return Stream(words, [np.where(c > 0, number[c], 0).astype(np.int32) for c in columns], self.counts[lo:hi])

    def pack(self) -> bytes:
        """First and second words as differences, everything by byte planes, compressed."""
        first, *rest = self.columns
        step = np.diff(first, prepend=np.int32(0))
        arrays = [step]
        if rest:
            same = step == 0
            arrays.append(np.where(same, np.diff(rest[0], prepend=np.int32(0)), rest[0]))
            arrays += rest[1:]
        arrays += [self.counts & 0xFFFFFFFF, self.counts >> 32]
        planes = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
        head = struct.pack("<IQQ", len(self.columns), len(self), len(self.words))
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes, b" ".join(self.words)]))

    @classmethod
    def unpack(cls, packed: bytes) -> Stream:
        content = zstandard.ZstdDecompressor().decompress(packed)
        wide, n, words = struct.unpack_from("<IQQ", content)
        at, arrays = 20, []
        for _ in range(wide + 2):
            planes = np.frombuffer(content, np.uint8, 4 * n, at).reshape(4, n)
            arrays.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
            at += 4 * n
        columns = [a.astype(np.int32) for a in arrays[:wide]]
        fresh = np.flatnonzero(columns[0] != 0) if n else np.empty(0, np.int64)
        columns[0] = np.cumsum(columns[0], dtype=np.int32)
        if wide > 1 and n:
            total = np.cumsum(columns[1].astype(np.int64))
            before = (total - columns[1])[fresh]
            columns[1] = (total - np.repeat(before, np.diff(np.append(fresh, n)))).astype(np.int32)
        counts = arrays[wide].astype(np.int64) | (arrays[wide + 1].astype(np.int64) << 32)
        return cls(content[at:].split(b" ") if words else [], columns, counts)


def block_stream(numbers: Numbers, ids: np.ndarray, longest: int) -> Stream:
    """The sorted distinct windows of a block; ``ids`` are word numbers with 0 at breaks."""
    known = [w for w in numbers if w != BREAK]
    order = sorted(range(len(known)), key=known.__getitem__)
    rank = np.zeros(len(known) + 1, np.int32)
    rank[np.array(order, np.int64) + 1] = np.arange(1, len(known) + 1)
    bits = max(1, len(known).bit_length())
    per_key = max(1, 63 // bits)
    keys = _window_keys(rank[ids], longest, bits, per_key)
    sort = np.lexsort(keys[::-1])
    fresh = np.zeros(len(sort), bool)
    fresh[:1] = True
    for i in range(len(keys)):
        keys[i] = keys[i][sort]
        fresh[1:] |= keys[i][1:] != keys[i][:-1]
    del sort
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(fresh)))
    columns = []
    for lo in range(0, longest, per_key):
        key, wide = keys.pop(0)[at], min(per_key, longest - lo)
        columns += [((key >> (bits * k)) & ((1 << bits) - 1)).astype(np.int32) for k in range(wide - 1, -1, -1)]
    return Stream([known[i] for i in order], columns, counts.astype(np.int64))


def _window_keys(ranked: np.ndarray, longest: int, bits: int, per_key: int) -> list[np.ndarray]:
    """The window at every word as a few numbers, ``per_key`` words in each; one column of words is held at a time."""
    starts = np.flatnonzero(ranked > 0).astype(np.int32)
    ranked = np.concatenate([ranked, np.zeros(longest, np.int32)])
    column = ranked[starts]
    keys = []
    for k in range(longest):
        if k:
            starts += 1
            column = np.where(column > 0, ranked[starts], 0)
        if k % per_key == 0:
            keys.append(column.astype(np.int64))
        else:
            keys[-1] <<= bits
            keys[-1] |= column
    return keys


def bounds_of(samples: Sequence[tuple[str, Key]], parts: int) -> list[tuple[str, Key]]:
    """Strictly rising bounds between ``parts`` parts, or fewer where samples repeat."""
    ordered = sorted(samples)
    chosen = [ordered[len(ordered) * k // parts] for k in range(1, parts)] if ordered else []
    return sorted(set(chosen))


class Merged:
    """The windows of one part and language, with the counts of the n-grams they start with."""

    def __init__(self, longest: int):
        self.longest = longest
        self.number: dict[bytes, int] = {b"": 0}
        self.columns: list[list[np.ndarray]] = [[] for _ in range(longest)]
        self.counts: list[np.ndarray] = []

    def add(self, stream: Stream) -> None:
        number = self.number
        ids = [0, *(number.setdefault(w, len(number)) for w in stream.words)]
        mapped = np.array(ids, np.int32)
        for held, c in zip(self.columns, stream.columns, strict=True):
            held.append(mapped[c])
        self.counts.append(stream.counts)

    def frequent(self, least: int, edges: Sequence[Key]) -> Iterator[tuple[int, bytes, int]]:
        """(words, phrase, count) of n-grams with ``least`` occurrences here, or that begin one of ``edges``."""
        words = list(self.number)
        columns = []
        while self.columns:
            columns.append(np.concatenate(self.columns.pop(0)))
        counts = np.concatenate(self.counts)
        self.counts = []
        wide = len(words)
        cut = [[self.number.get(w) for w in edge] for edge in edges]
        group = np.zeros(len(counts), np.int64)
        open_edges = {k: 0 for k in range(len(cut))}  # edge -> its group at the level before
        for k in range(self.longest):
            there = columns[k] > 0
            if not there.all():
                columns, counts, group = [c[there] for c in columns], counts[there], group[there]
            if not len(counts):
                return
            key = group * wide + columns[k]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(counts[order], first)
            keep = total >= least
            still = {}
            for edge, of in open_edges.items():
                word = cut[edge][k] if k < len(cut[edge]) else None
                if word:
                    at = int(np.searchsorted(key[first], of * wide + word))
                    if at < len(first) and key[first[at]] == of * wide + word:
                        keep[at] = True
                        still[edge] = at
            kept = np.flatnonzero(keep)
            some = order[first[kept]]
            named = [c[some].tolist() for c in columns[: k + 1]]
            for row in zip(total[kept].tolist(), *named, strict=True):
                yield k + 1, b" ".join([words[w] for w in row[1:]]), row[0]
            new = np.cumsum(keep) - 1
            open_edges = {edge: int(new[at]) for edge, at in still.items()}
            member = np.repeat(np.where(keep, new, -1), np.diff(np.append(first, len(key))))
            back = np.empty(len(key), np.int64)
            back[order] = member
            stay = back >= 0
            columns, counts, group = [c[stay] for c in columns], counts[stay], back[stay]


def _streams(docs: DataFrame, lang: str, text: str, longest: int, block_words: int, chunk: int, sample: int) -> DataFrame:
    """One row per chunk: lang, n (word occurrences), windows, heads (a key per ``sample`` windows), packed.

    The first of the keys lies at another place in every chunk: blocks are alike, and keys at the same ranks of all of them
    would leave long stretches of the order without any.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    fields = pa.schema(
        [("lang", pa.string()), ("n", pa.int64()), ("windows", pa.int64()), ("heads", pa.list_(pa.binary())), ("packed", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size, chunks = 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, chunks
            while held:
                of, (numbers, parts) = held.popitem()
                ids = np.concatenate(parts)
                parts.clear()
                stream = block_stream(numbers, ids, longest)
                del numbers, parts, ids
                for lo in range(0, len(stream), chunk):
                    piece = stream.cut(lo, min(lo + chunk, len(stream)))
                    begin = zlib.crc32(struct.pack("<II", task, chunks)) % sample
                    chunks += 1
                    heads = [b" ".join(piece.key(i)) for i in range(begin, len(piece), sample)]
                    row = [[of], [int(piece.counts.sum())], [len(piece)], [heads], [piece.pack()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, fields, strict=True)], schema=fields)
                stream = piece = heads = row = None
            size = 0
            forget_recent()  # the block's memory goes back to the system: the worker lives on beside the next stage's

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                content = texts[i].as_py()
                found = marked_words(content) if content else []
                if not found:
                    continue
                of = langs[i].as_py()
                if of not in held:
                    held[of] = (Numbers(), [])
                numbers, parts = held[of]
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                size += len(found)
                if size >= block_words:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, n bigint, windows bigint, heads array<binary>, packed binary")


def count_ngrams(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    lang: str = "lang",
    text: str = "text",
    block_words: int = 1 << 21,
    part_windows: int = 1 << 20,
    chunk: int = 1 << 19,
) -> tuple[DataFrame, DataFrame]:
    """N-grams of 1 to ``longest`` words with ``least`` occurrences or more (lang, size, phrase, f), and words per lang (lang, n).

    Words and pieces as in ``collocations``. The driver holds the bounds of the parts: one window per ``part_windows``
    distinct windows of the blocks, and 16 times as many samples while it chooses them. A task holds a block or a part,
    and beside it a batch of texts or chunks of at most 8 MB.
    """
    small_batches(docs.sparkSession)
    streams = written(_streams(docs, lang, text, longest, block_words, chunk, max(1, part_windows // 16)), "ngram-streams")
    sums = streams.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    totals = written(sums, "ngram-totals")
    windows = totals.agg(F.sum("windows")).first()[0] or 0
    heads = streams.select("lang", F.explode("heads").alias("head")).collect() if windows > part_windows else []
    samples = [(r["lang"], tuple(bytes(r["head"]).split(b" "))) for r in heads]
    bounds = bounds_of(samples, -(-windows // part_windows))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, stream = batch.column(0)[i].as_py(), Stream.unpack(batch.column(1)[i].as_py())
                part = bisect.bisect_right(bounds, (of, stream.key(0)))
                last = bisect.bisect_right(bounds, (of, stream.key(len(stream) - 1)))
                lo = 0
                while lo < len(stream):
                    hi = len(stream)
                    if part < last:
                        hi = bisect.bisect_left(range(len(stream)), bounds[part], lo=lo, key=lambda j: (of, stream.key(j)))
                    if hi > lo:
                        row = [[part], [of], [stream.cut(lo, hi).pack()]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.binary()), strict=True)],
                            names=["part", "lang", "packed"],
                        )
                    lo, part = hi, part + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, merged = None, Merged(longest)

        def close() -> Iterator[pa.RecordBatch]:
            part, of = at
            edges = [key for k in (part - 1, part) if 0 <= k < len(bounds) for name, key in [bounds[k]] if name == of]
            found = list(merged.frequent(least, edges))
            for lo in range(0, len(found), 50_000):
                some = found[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([of] * len(some), pa.string()),
                        pa.array([s for s, _, _ in some], pa.int32()),
                        pa.array([p for _, p, _ in some], pa.binary()).cast(pa.string()),
                        pa.array([f for _, _, f in some], pa.int64()),
                    ],
                    names=["lang", "size", "phrase", "f"],
                )

        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if here != at:
                    if at is not None:
                        yield from close()
                    at, merged = here, Merged(longest)
                    forget_recent()
                merged.add(Stream.unpack(batch.column(2)[i].as_py()))
        if at is not None:
            yield from close()

    parted = streams.select("lang", "packed").mapInArrow(split, "part int, lang string, packed binary")
    parted = parted.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "lang")
    shares = parted.mapInArrow(merge, "lang string, size int, phrase string, f bigint")
    grams = shares.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return written(grams, "ngrams"), totals.select("lang", "n")


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    percent: int = 80,
    top: int | None = 2000,
    lang: str = "lang",
    text: str = "text",
    **sizes: int,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more, by lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. a, l and r are
    the occurrences inside pieces of the phrase, of its first words and of the rest, for the cut with the lowest
    floor(2000000 * a / (l + r)), of equals the one after fewest words; n counts the words of the language. Phrases inside a
    phrase one or more words longer that occurs at least ``percent`` % as often are left out. Each language gives its
    first ``top`` (all if None) by score, then a, both descending, then by the phrase's bytes. Arithmetic is exact.

    Null and empty texts have no words, a null lang is ``und``; repeated rows count as often as they come; other columns
    are not read, and without words there are no rows. ``sizes`` goes to ``count_ngrams``.
    """
    grams, totals = count_ngrams(docs, least, longest, lang, text, **sizes)
    head = F.expr("substring_index(phrase, ' ', size - 1)")
    tail = F.expr("substring_index(phrase, ' ', 1 - size)")
    streams = grams.withColumns({"head": head, "tail": tail})
    none = F.array().cast("array<bigint>")
    shorter = grams.filter("size = 1").select("lang", "phrase", "f", none.alias("lefts"), none.alias("rights"))
    levels = []
    for size in range(2, longest + 1):
        a = shorter.select("lang", F.col("phrase").alias("head"), F.concat("lefts", F.array("f")).alias("lefts"))
        b = shorter.select("lang", F.col("phrase").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
        mine = streams.filter(F.col("size") == size).join(a.hint("merge"), ["lang", "head"])
        shorter = written(mine.join(b.hint("merge"), ["lang", "tail"]).select("lang", "phrase", "f", "lefts", "rights"), "ngram-level")
        levels.append(shorter)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    longer = streams.filter("size > 2")
    ends = longer.select("lang", F.col("head").alias("phrase"), "f").unionByName(longer.select("lang", F.col("tail").alias("phrase"), "f"))
    extension = ends.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = found.join(extension.hint("merge"), ["lang", "phrase"], "left")
    wide = "decimal(20, 0)"
    covered = F.lit(100).cast(wide) * F.col("longer").cast(wide) >= F.lit(percent).cast(wide) * F.col("f").cast(wide)
    found = found.filter(F.col("longer").isNull() | ~covered)
    score = "cast(2000000 as decimal(10, 0)) * cast(f as decimal(20, 0)) div cast(lefts[i] + rights[i] as decimal(20, 0))"
    cut = f"array_min(transform(sequence(0, size(lefts) - 1), i -> struct({score} as score, i, lefts[i] as l, rights[i] as r)))"
    scored = found.withColumn("cut", F.expr(cut)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
