"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals blocks out to shards.

Each source is a stream of words: its documents in a permuted order, as often as the target asks for. The stream is
cut into blocks. The root of the tree holds how many blocks each source gives; a node hands its left half a draw
without replacement (multivariate hypergeometric) from its counts, and the right half the rest, down to single
shards. A shard's blocks of a source follow those of the shards before it, in a permuted block order, so that all draws
are disjoint. Any task finds the shard of a block by walking down; node draws are seeded by the node, so that they agree
wherever and whenever they are made. Inside a shard the pieces are shuffled by a seeded hash. What a document gives to
the mix is the sum of its pieces as the shards hold them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.llm.common import mixed
from marketprose.operators.lookups import fits_broadcast
from marketprose.operators.windows import offsets
from marketprose.session import written

WORDS = r"[^\x20\x09-\x0D]+"
NUMPY_DRAWS = 10**9  # numpy draws from fewer


def hypergeometric(rng: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """How many of ``wanted`` draws without replacement are good; for counts of any size that a double can tell apart.

    Beyond numpy's range by rejection: the probabilities are log-concave, so around the mode they lie below a constant
    and further out below an exponential.
    """
    if good + bad < NUMPY_DRAWS:
        return int(rng.hypergeometric(good, bad, wanted))
    low, high = max(0, wanted - bad), min(good, wanted)
    mode = min(max((wanted + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_weight(k: int) -> float:
        parts = (k, good - k, wanted - k, bad - wanted + k)
        return -sum(math.lgamma(p + 1) for p in parts)

    top = log_weight(mode)
    whole = math.lgamma(good + 1) + math.lgamma(bad + 1) + math.lgamma(wanted + 1) + math.lgamma(good + bad - wanted + 1)
    peak = math.exp(min(0.0, top + whole - math.lgamma(good + bad + 1)))  # probability of the mode
    width = 1 + peak / 2
    while True:
        u, height = rng.random(), rng.random()
        if u <= width / (1 + width):
            away = rng.random() * width / peak
            bound = 1.0
        else:
            tail = rng.exponential()
            away, bound = (width + tail) / peak, math.exp(-tail)
        k = mode + (1 if rng.random() < 0.5 else -1) * round(away)
        if low <= k <= high and math.log(max(height * bound, 1e-300)) <= log_weight(k) - top:
            return k


def scattered(values: np.ndarray, size: int, seed: Sequence[int]) -> np.ndarray:
    """A seeded permutation of 0 .. size - 1, at the given places: rounds over two halves of the bits, repeated for what
    falls outside."""
    half = max(1, -(-max(1, size - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(list(seed)).integers(1, 1 << 63, 4).astype(np.uint64)
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        high, low = out[todo] >> shift, out[todo] & mask
        for key in keys:
            high, low = low, high ^ (mixed(low + key) & mask)
        out[todo] = (high << shift) | low
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: float) -> list[float]:
    """Targets in proportion to the weights, none above ``repeats`` times its size; what is cut off is shared again."""
    caps = [float(repeats * s) for s in sizes]
    target, free, left = [0.0] * len(caps), set(range(len(caps))), float(total)
    while free and (weight := sum(weights[i] for i in free)) > 0:
        level = left / weight
        over = [i for i in free if level * weights[i] > caps[i]]
        for i in over or free:
            target[i] = caps[i] if over else level * weights[i]
        if not over:
            break
        left -= sum(caps[i] for i in over)
        free -= set(over)
    return target


class SplittingTree:
    """Which shard gets a block, for block counts per source and a number of shards."""

    def __init__(self, blocks: Sequence[int], shards: int, seed: int = 0):
        self.blocks, self.shards, self.seed = np.array(blocks, np.int64), shards, seed
        self._draws: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        """Blocks per source that the left half of the shards [lo, hi) draws from the node's counts."""
        if (lo, hi) not in self._draws:
            if len(self._draws) > 10_000:
                self._draws.clear()
            wanted = int(counts.sum()) * ((lo + hi) // 2 - lo) // (hi - lo)
            rng = np.random.default_rng([self.seed, lo, hi])
            drawn, rest = np.zeros(len(counts), np.int64), int(counts.sum())
            for k, count in enumerate(counts.tolist()):  # each source in turn against all that follow it
                rest -= count
                drawn[k] = hypergeometric(rng, count, rest, wanted)
                wanted -= int(drawn[k])
            self._draws[lo, hi] = drawn
        return self._draws[lo, hi]

    def permuted(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Place of each block in its source's permuted order, a bijection for each source."""
        out = np.empty(len(block), np.int64)
        for s in np.unique(source):
            mine = source == s
            out[mine] = scattered(block[mine], int(self.blocks[s]), (self.seed, int(s), 1))
        return out

    def shard(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), np.int64)
        nodes = [(0, self.shards, self.blocks, np.arange(len(block)), self.permuted(source, block))]
        while nodes:
            lo, hi, counts, rows, place = nodes.pop()
            if hi - lo == 1 or not len(rows):
                out[rows] = lo
                continue
            left, mid = self.left(lo, hi, counts), (lo + hi) // 2
            bound = left[source[rows]]
            goes = place < bound
            nodes.append((lo, mid, left, rows[goes], place[goes]))
            nodes.append((mid, hi, counts - left, rows[~goes], (place - bound)[~goes]))
        return out

    def quotas(self, shard: int) -> np.ndarray:
        """Blocks per source of one shard."""
        lo, hi, counts = 0, self.shards, self.blocks
        while hi - lo > 1:
            left, mid = self.left(lo, hi, counts), (lo + hi) // 2
            lo, hi, counts = (lo, mid, left) if shard < mid else (mid, hi, counts - left)
        return counts


class Mix:
    """A mix of ``docs``: ``sizes`` (per row: row, doc_id, source, mark, size), ``targets`` (per source) and ``pieces``.

    ``weigh`` gives a weight per source from the list of sources, which are sorted by code point, null last. The
    sources share ``share`` times all words; no target is above ``repeats`` times its source's size. One row per source
    is held in the driver, as the list of weights of any mix is; nothing else is.

    Pieces are what the splitting tree dealt out, written with their shard and their position inside it; everything else
    is read from that table. Blocks have ``block_words`` words. Null texts have no words, and rows without words are never
    part of a piece. Every row is a document of its own, also when it repeats an id. Columns with other names are not read.
    """

    def __init__(
        self,
        docs: DataFrame,
        weigh: Callable[[list[str | None]], Sequence[float]],
        share: float = 1.5,
        repeats: int = 2,
        block_words: int = 1024,
        blocks_per_shard: int = 4096,
        bucket_rows: int = 50_000,
        seed: int = 0,
        key: str = "doc_id",
        source: str = "source",
        text: str = "text",
    ):
        spark = docs.sparkSession
        self.key, self.source, self.text, self.seed = key, source, text, seed
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
            self._mark().alias("mark"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        )
        self.sizes = written(rows, "mix-sizes")
        sums = self.sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        names, totals = [r["source"] for r in sums], [int(r["n"]) for r in sums]
        targets = water_fill(totals, weigh(names), share * sum(totals), repeats)
        wanted = [round(t) for t in targets]
        self.block_words = block_words
        blocks = [-(-w // block_words) for w in wanted]
        self.tree = SplittingTree(blocks, max(1, -(-sum(blocks) // blocks_per_shard)), seed)
        self.targets = spark.createDataFrame(
            list(zip(names, range(len(names)), totals, targets, wanted, strict=True)),
            "source string, source_no int, source_size bigint, target double, wanted bigint",
        )
        self.pieces = written(self._pieces(repeats, max(1, -(-sum(r["rows"] for r in sums) // bucket_rows))), "mix-pieces")

    def _mark(self) -> Column:
        """Tells rows of one id and source apart by their text."""
        return F.xxhash64(F.col(self.text))

    def _numbered(self) -> DataFrame:
        t = self.targets.withColumnRenamed("source", "_source")
        return self.sizes.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def _pieces(self, repeats: int, buckets: int) -> DataFrame:
        """Runs of words: shard, position (1.. inside the shard), source, source_no, block, row, doc_id, copy, first_word, words."""
        copies = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
        rows = self._numbered().filter("size > 0").withColumn("copy", copies)
        # words of this copy of the stream that the mix takes
        rows = rows.withColumn("quota", F.least("source_size", F.col("wanted") - F.col("copy") * F.col("source_size")))
        rows = rows.filter("quota > 0")
        seed = F.lit(self.seed)
        order = F.xxhash64("doc_id", "mark", "copy", seed)
        rows = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
        keys = ["source_no", "copy"]
        inside = Window.partitionBy(*keys, "bucket").orderBy("order", "doc_id", "mark", "row")
        inside = inside.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(offsets(rows, keys, "bucket", F.col("size")), [*keys, "bucket"])
        rows = rows.withColumn("offset", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        rows = rows.withColumn("take", F.least("size", F.col("quota") - F.col("offset"))).filter("take > 0")
        start = F.col("copy") * F.col("source_size") + F.col("offset")
        words = F.lit(self.block_words)
        cut = rows.select(
            "source", "source_no", "row", "doc_id", "copy", start.alias("start"), "take",
            F.explode(F.sequence(F.floor(start / words), F.floor((start + F.col("take") - 1) / words))).alias("block"),
        )
        first = F.greatest(F.col("block") * words, F.col("start"))
        last = F.least((F.col("block") + 1) * words, F.col("start") + F.col("take"))
        tree = self.tree

        @F.pandas_udf("bigint")
        def shard(source: pd.Series, block: pd.Series) -> pd.Series:
            return pd.Series(tree.shard(source.to_numpy(np.int64), block.to_numpy(np.int64)))

        dealt = cut.select(
            shard("source_no", "block").alias("shard"), "source", "source_no", "block", "row", "doc_id", "copy",
            (first - F.col("start")).alias("first_word"), (last - first).alias("words"),
        )
        shuffled = Window.partitionBy("shard").orderBy(
            F.xxhash64(seed, "source_no", "block", "doc_id", "copy", "first_word"), "source_no", "block", "doc_id", "copy", "first_word", "row",
        )
        return dealt.withColumn("position", F.row_number().over(shuffled))

    def taken(self) -> DataFrame:
        """Per row: row, doc_id, source, source_no, mark, size, taken (words of its pieces in all shards), shards."""
        used = self.pieces.groupBy("row").agg(
            F.sum("words").cast("bigint").alias("taken"), F.collect_set("shard").alias("shards")  # a document's own pieces
        )
        rows = self._numbered().select("row", "doc_id", "source", "source_no", "mark", "size")
        found = rows.join(used, "row", "left")
        none = F.array().cast("array<bigint>")
        return found.withColumns({"taken": F.coalesce("taken", F.lit(0).cast("bigint")), "shards": F.coalesce("shards", none)})

    def documents(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, each as often as the mix takes its words, rounded, in the order of shard and position.

        All columns are kept. A copy stands where its first piece stands; sorted by range, so that files written from
        it hold the shards one after the other. Rows with equal ids, sources and texts share their words evenly.
        """
        count = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
        alike = ["doc_id", "source", "mark"]
        used = self.taken().filter("taken > 0").groupBy(*alike).agg(count.alias("copies")).filter("copies > 0")
        first = F.min(F.struct("shard", "position"))
        places = self.pieces.groupBy("row", "copy").agg(first.alias("place"))
        rows = self.sizes.select("row", *alike)
        # repeated rows may number in the thousands, so each copy number keeps one place
        places = places.join(rows, "row").groupBy(*alike, "copy").agg(F.min("place").alias("place"))
        places = places.groupBy(*alike).agg(F.array_sort(F.collect_list("place")).alias("places"))  # one per copy number
        same = [F.col(f"u.{c}").eqNullSafe(F.col(f"p.{c}")) for c in alike]
        used = used.alias("u").join(places.alias("p"), same).select("u.*", "p.places")
        used = written(used.select(*[F.col(c).alias(f"_{c}") for c in alike], "copies", "places"), "mix-copies")
        used = F.broadcast(used) if fits_broadcast(used) else used
        # the rows travel as one column, so that no name of theirs can clash
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rows = docs.select(
            row.alias("row"), F.col(self.key).alias("doc_id"), F.col(self.source).cast("string").alias("source"), self._mark().alias("mark")
        )
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]
        again = rows.join(used, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        place = F.element_at("places", F.least("copy", F.size("places")))
        again = again.select("row", place["shard"].alias("shard"), place["position"].alias("position"))
        return again.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").select("row.*")
