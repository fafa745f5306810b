"""N-gram language model: counting, tries and scoring by one exchange between blocks of text and shards of the model.

A block holds about a million tokens of whole documents. It sends each shard the contexts and words that it needs from
it, each once, with how often they occur in training documents. A shard adds up what all blocks sent, builds its
trie (``trie``), and answers every block from the memory-mapped file. So counts are summed before they are moved, no
task holds more than a block or a shard, and nothing of the model passes the driver but the counts of the
most frequent words.

P(w | context) is interpolated: a discounted share of the context's count plus the context's remaining weight times
the probability after the context without its first word; discounts for counts of 1, 2, and 3 or more are estimated from the
shard. Single words have (c + 1) / (N + V + 1).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from marketprose.llm import trie
from marketprose.llm.common import as_key, filesystem, forget_recent, keyed, mixed, new_folder, put_file, word_hashes
from marketprose.session import written

END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds white space
START = np.uint64(xxhash.xxh3_64_intdigest(b"\t"))
ODD = np.uint64(0x9E3779B97F4A7C15)
WORD_BITS = np.uint64(24)  # dropped from a word's hash when it follows a context
HOT_SHARE = 1000  # a word with more than one of so many tokens is dealt over several shards as a context


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 3)


def unsqueeze(content: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content), kind)


def text_blocks(docs: DataFrame, training: Column, key: str, text: str, block_tokens: int) -> DataFrame:
    """Documents as runs of word numbers: block, docs (ids), held (flags), lengths, ids, vocabulary (sorted hashes)."""
    rows = docs.select(
        as_key(key).alias("doc_id"), (~training).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    schema = (
        "block bigint, docs array<string>, held array<boolean>, lengths array<bigint>, ids binary, vocabulary binary, "
        "tokens bigint, trained bigint, frequent array<bigint>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[str | None, bool, np.ndarray]] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal held, size, number
            lengths = [len(h) for _, _, h in held]
            vocabulary, ids = np.unique(np.concatenate([h for _, _, h in held]), return_inverse=True)
            train = np.repeat([not out for _, out, _ in held], lengths)
            counts = np.bincount(ids[train], minlength=len(vocabulary))
            frequent = vocabulary[counts * HOT_SHARE > train.sum()]
            if sum(not out for _, out, _ in held) * HOT_SHARE > train.sum():
                frequent = np.append(frequent, START)
            row = pd.DataFrame({
                "block": [number], "docs": [[d for d, _, _ in held]], "held": [[o for _, o, _ in held]], "lengths": [lengths],
                "ids": [squeeze(ids.astype("<u4"))], "vocabulary": [vocabulary.astype("<u8").tobytes()],
                "tokens": [len(ids)], "trained": [int(train.sum())], "frequent": [frequent.view(np.int64).tolist()],
            })
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for doc, out, content in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                hashes = np.append(word_hashes(content), END)
                held.append((doc, bool(out), hashes))
                size += len(hashes)
                if size >= block_tokens:
                    yield close()
        if held:
            yield close()
        forget_recent()

    return rows.mapInPandas(run, schema)


class Block:
    """The n-grams of a block: per level the distinct contexts, the distinct pairs of context and word, their counts."""

    def __init__(self, row, order: int):
        self.lengths = np.array(row.lengths, np.int64)
        self.ids = unsqueeze(row.ids, "<u4").astype(np.int64)
        self.vocabulary = np.frombuffer(row.vocabulary, "<u8")
        self.train = np.repeat(~np.array(row.held, bool), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        size = len(self.vocabulary)
        self.seen = np.bincount(self.ids[self.train], minlength=size)
        self.levels = []
        # the word before, or the start of a text
        before = np.concatenate([[size], self.ids[:-1]])
        before[self.first] = size
        hashes = np.append(self.vocabulary, START)
        at = np.arange(len(self.ids))
        for _ in range(2, order + 1):
            pair, inverse = np.unique(before[at] * np.int64(size) + self.ids[at], return_inverse=True)
            counts = np.bincount(inverse[self.train[at]], minlength=len(pair))
            context, word = pair // size, pair % size
            self.levels.append((hashes, context, word, counts, at, inverse))
            # the longer contexts are these pairs; a text's first word has none
            full = np.full(len(self.ids) + 1, -1, np.int64)
            full[at + 1] = inverse
            with np.errstate(over="ignore"):
                hashes = mixed(hashes[context] * ODD + self.vocabulary[word])
            full[self.first] = -1
            before = full[:-1]
            at = np.flatnonzero(before >= 0)

    def parts(self, level: int, shards: int, hot: dict[int, int], total: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, the contexts it gets (numbers, ascending) and the pairs it gets (numbers, ascending)."""
        hashes, context, word, *_ = self.levels[level]
        used = np.arange(len(hashes)) if not level else np.unique(context)
        home = (mixed(hashes) % np.uint64(shards)).astype(np.int64)
        spread = np.ones(len(hashes), np.int64)
        if not level:
            for at in np.flatnonzero(np.isin(hashes.view(np.int64), list(hot))):
                spread[at] = min(shards, 1 + hot[int(hashes.view(np.int64)[at])] * 2 * shards // max(1, total))
        step = (mixed(self.vocabulary)[word] % spread[context].astype(np.uint64)).astype(np.int64)
        goes = (home[context] + step) % shards
        order = np.argsort(goes, kind="stable")
        bounds = np.searchsorted(goes[order], np.arange(shards + 1))
        # a context goes to all the shards that may hold a part of it
        copies = np.repeat(used, spread[used])
        nth = np.arange(len(copies)) - np.repeat(np.cumsum(spread[used]) - spread[used], spread[used])
        where = (home[copies] + nth) % shards
        by = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[by], np.arange(shards + 1))
        for shard in range(shards):
            yield shard, copies[by[ends[shard] : ends[shard + 1]]], order[bounds[shard] : bounds[shard + 1]]


def requests(blocks: DataFrame, order: int, shards: int, hot: dict[int, int], total: int) -> DataFrame:
    """What blocks ask shards: contexts (hashes), seen (their occurrences as words), fan (pairs per context), words, counts."""
    schema = "shard int, block bigint, level int, contexts binary, seen binary, fan binary, words binary, counts binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row, order)
                words = (block.vocabulary >> WORD_BITS).astype("<u8")
                short = words.view(np.uint8).reshape(-1, 8)[:, :5]
                for level, (hashes, context, word, counts, *_) in enumerate(block.levels):
                    out = []
                    seen = np.append(block.seen, 0).astype("<u4") if not level else np.zeros(len(hashes), "<u4")
                    for shard, chosen, pairs in block.parts(level, shards, hot, total):
                        if len(chosen):
                            fan = np.bincount(np.searchsorted(chosen, context[pairs]), minlength=len(chosen)).astype("<u4")
                            out.append((
                                shard, row.block, level, hashes[chosen].tobytes(), seen[chosen].tobytes(), fan.tobytes(),
                                short[word[pairs]].tobytes(), counts[pairs].astype("<u4").tobytes(),
                            ))
                    yield pd.DataFrame(out, columns="shard block level contexts seen fan words counts".split())

    return blocks.mapInPandas(run, schema)


def wide(short: bytes) -> np.ndarray:
    raw = np.frombuffer(short, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def answers(rows: pd.DataFrame, folder: str, shards: int, hot: dict[int, int]) -> pd.DataFrame:
    """Build the trie of one shard and level from all blocks' counts, and look up what each block asked for."""
    shard, level = int(rows["shard"].iloc[0]), int(rows["level"].iloc[0])
    kinds = {"contexts": "<u8", "seen": "<u4", "fan": "<u4", "counts": "<u4"}
    asked = [{c: np.frombuffer(getattr(r, c), k) for c, k in kinds.items()} | {"words": wide(r.words)} for r in rows.itertuples()]

    def every(name: str) -> np.ndarray:
        return np.concatenate([a[name] for a in asked])

    contexts, number = np.unique(every("contexts"), return_inverse=True)
    seen = np.bincount(number, every("seen"), len(contexts)).astype(np.int64)
    counts = every("counts").astype(np.int64)
    use = counts > 0
    owner = np.repeat(number, every("fan"))[use]
    known = (seen > 0) | (np.bincount(owner, minlength=len(contexts)) > 0)  # only what training documents hold
    contexts, seen, owner = contexts[known], seen[known], (np.cumsum(known) - 1)[owner]
    words, rank = np.unique(every("words")[use], return_inverse=True)
    size = max(1, len(words))
    keys, inverse = np.unique(owner * size + rank, return_inverse=True)
    summed = np.bincount(inverse, counts[use], len(keys)).astype(np.int64)
    owner, word = keys // size, words[keys % size]
    totals = np.bincount(owner, summed, len(contexts)).astype(np.int64)
    if not level:
        totals = np.array([hot.get(c, t) for c, t in zip(contexts.view(np.int64).tolist(), totals.tolist(), strict=True)], np.int64)
    path = f"{folder}/level{level + 2}-shard{shard:06d}.trie"
    put_file(path, trie.build(contexts, seen, owner, word, summed, totals))
    model, close = mapped(path)
    out = []
    for block, a in zip(rows["block"], asked, strict=True):
        at = model.lookup(a["contexts"])
        alpha = model.search(np.repeat(at, a["fan"]), a["words"])
        # a context's remaining weight; what several shards say of one context is added up
        gamma = np.where(at >= 0, model.gamma[at], 0) if len(contexts) else np.zeros(len(at))
        seen_of = np.where(at >= 0, model.counts[at], 0) if len(contexts) else np.zeros(len(at))
        out.append((block, level, shard, squeeze(alpha), squeeze(gamma.astype("<u2")), squeeze(seen_of.astype("<u4")), 0))
    if not level:
        home = mixed(contexts) % np.uint64(shards) == np.uint64(shard)
        out.append((-1, level, shard, b"", b"", b"", int((home & (seen > 0)).sum())))
    close()
    return pd.DataFrame(out, columns="block level shard alpha gamma counts vocabulary".split())


def mapped(path: str):
    """The trie of a file, memory-mapped; from a store that has no local files by way of a temporary one."""
    store, local = filesystem(path)
    temporary = None
    if store.type_name != "local":
        handle, temporary = tempfile.mkstemp(suffix=".trie")
        with os.fdopen(handle, "wb") as out, store.open_input_stream(local) as source:
            while part := source.read(1 << 24):
                out.write(part)
        local = temporary
    content = np.memmap(local, np.uint8, "r")

    def close() -> None:
        if temporary:
            os.remove(temporary)

    return trie.opened(content), close


def scored(row, replies: pd.DataFrame, order: int, shards: int, hot: dict[int, int], total: int, vocabulary: int) -> pd.DataFrame:
    """The documents of a block with their log10 probabilities."""
    block = Block(row, order)
    size = len(block.vocabulary)
    by = {(int(r.level), int(r.shard)): r for r in replies.itertuples()}
    known, probability = np.zeros(size, np.int64), np.zeros(len(block.ids))
    single = None
    for level, (hashes, context, _, _, at, inverse) in enumerate(block.levels):
        alpha, gamma = np.zeros(len(context), "<u2"), np.zeros(len(hashes))
        for shard, chosen, pairs in block.parts(level, shards, hot, total):
            if not len(chosen):
                continue
            reply = by[level, shard]
            alpha[pairs] = unsqueeze(reply.alpha, "<u2")
            gamma[chosen] += trie.from_code(unsqueeze(reply.gamma, "<u2"))
            if not level:
                counts = np.append(known, 0)
                counts[chosen] = unsqueeze(reply.counts, "<u4")
                known = counts[:size]
        if single is None:
            single = (known + 1.0)[block.ids] / (total + vocabulary + 1.0)
            probability = single.copy()
        gamma[gamma == 0] = 1.0  # never followed by anything in training
        probability[at] = trie.from_code(alpha)[inverse] + gamma[context[inverse]] * probability[at]
    sums = {name: np.add.reduceat(v, block.first) for name, v in (("base_score", np.log10(single)), ("score", np.log10(probability)))}
    out = {"doc_id": list(row.docs), "held_out": row.held, "n_tokens": block.lengths}
    out |= {"n_known": np.add.reduceat((known > 0)[block.ids].astype(np.int64), block.first), "train_tokens": total}
    return pd.DataFrame(out | sums)


def hot_words(blocks: DataFrame, total: int) -> dict[int, int]:
    """Training occurrences of the words that stand out: at most 2 * HOT_SHARE, since their counts add up to the total."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(_occurrences(row, np.array(row.frequent, np.int64)), columns=["word", "n"])

    found = blocks.filter(F.size("frequent") > 0).mapInPandas(local, "word bigint, n bigint")
    found = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * HOT_SHARE > total)
    words = np.array([r["word"] for r in found.collect()], np.int64)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(_occurrences(row, words), columns=["word", "n"])

    if not len(words):
        return {}
    sums = blocks.mapInPandas(exact, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in sums.collect()}


def _occurrences(row, words: np.ndarray) -> list[tuple[int, int]]:
    vocabulary = np.frombuffer(row.vocabulary, "<u8").view(np.int64)
    held = np.array(row.held, bool)
    train = np.repeat(~held, np.array(row.lengths, np.int64))
    counts = dict(zip(vocabulary.tolist(), np.bincount(unsqueeze(row.ids, "<u4")[train], minlength=len(vocabulary)).tolist(), strict=True))
    counts[int(np.array([START]).view(np.int64)[0])] = int((~held).sum())
    return [(w, counts.get(w, 0)) for w in words.tolist()]


def score(
    docs: DataFrame,
    training: Column,
    order: int = 2,
    key: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    block_tokens: int = 1 << 20,
    shard_tokens: int = 1_000_000,
) -> DataFrame:
    """Learn from the rows where ``training`` is true and score all whole texts.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end per document; null texts count as empty and
    have the end only. Each row is a document, repeated rows count each time. Columns: doc_id, held_out, n_tokens,
    n_known (tokens that training holds), train_tokens, base_score (sum of log10 of (c + 1) / (N + V + 1)), score (log10
    probability under the model). The trie files stay in ``folder``, or are dropped with the session's scratch folder.
    """
    spark = docs.sparkSession
    if order < 2:
        raise ValueError("order must be at least 2")
    folder = folder or new_folder(spark, "tries")
    blocks = written(text_blocks(docs, training, key, text, block_tokens), "lm-blocks")
    sums = blocks.agg(F.sum("trained"), F.sum("tokens")).first()
    total, shards = sums[0] or 0, max(1, (sums[1] or 0) * (order - 1) // shard_tokens)
    hot = hot_words(blocks, total)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        return answers(rows, folder, shards, hot)

    reply = "block bigint, level int, shard int, alpha binary, gamma binary, counts binary, vocabulary bigint"
    asked = requests(blocks.drop("docs", "frequent"), order, shards, hot, total)
    replies = written(asked.groupBy("shard", "level").applyInPandas(answer, reply), "lm-replies")
    vocabulary = replies.filter("block < 0").agg(F.sum("vocabulary")).first()[0] or 0

    def combine(block: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        parts = [scored(row, said, order, shards, hot, total, vocabulary) for row in block.itertuples()]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    said = replies.filter("block >= 0").drop("vocabulary")
    return keyed(blocks.drop("frequent").groupBy("block").cogroup(said.groupBy("block")).applyInPandas(combine, schema))
