"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one node. Nodes that share their smallest shingle hash go into groups of a few
dozen; the token-group matrix holds the union of each group's tokens. Its part that can start a match (the prefix of
each set under one global token order) proposes pairs of groups; the union then bounds how much of each document
can be missing from the other group, and only qualifying groups are opened and compared set by set.

Large families of near copies are linked first, every group with one other per token; what is connected by then is
one class, and later only groups of different classes are paired. Tokens of many classes (shared passages) are put
last in the token order, which keeps them out of the prefixes; a document with too few other tokens falls back on its
whole set. So no pair above the threshold between different classes can be missed, and no family is ever written out
as pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.llm.common import as_key, forget_recent, keyed, shingle_hashes, word_hashes
from marketprose.llm.graph import components
from marketprose.operators import lookups
from marketprose.session import discard, small_batches, written

MAX_SENT = 8 << 20  # bytes of a table that goes to all tasks; many go in one run
GROUP = 48  # documents of a group, on average
FREQUENT = 16  # classes that share a token before it is put last
LED_PERCENT = 30  # of a prefix
MARKS = 16  # 64-bit words of a node's marks, a power of two


keyed_join = functools.partial(lookups.keyed_join, max_bytes=MAX_SENT)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which two sets above the threshold must share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def reserve_length(n: int, percent: int) -> int:
    """Smallest hashes that travel with a document: its prefix and half as much again for frequent tokens."""
    return min(n, prefix_length(n, percent) * 3 // 2 + 2)


def slack(n: int, m: int, percent: int) -> int:
    """Most tokens two sets of these sizes can have apart and still be above the threshold."""
    return (100 - percent) * (n + m) // (100 + percent)


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def unpacked(content: bytes) -> np.ndarray:
    return np.frombuffer(content, "<u8")


def token_sets(docs: DataFrame, size: int, key: str, text: str, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, node (hash of the set), tokens: the whole set or its smallest hashes, packed and sorted."""
    rows = docs.select(as_key(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_recent()
        for batch in batches:
            sets = [shingle_hashes(word_hashes(t), size) for t in batch["text"]]
            n = [len(s) for s in sets]
            node = [xxhash.xxh3_64_intdigest(packed(s)) - (1 << 63) for s in sets]
            tokens = [packed(s if whole else s[: reserve_length(len(s), percent)]) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "node": node, "tokens": tokens})
        forget_recent()

    return keyed(rows.mapInPandas(run, "doc_id string, n bigint, node bigint, tokens binary"))


def exploded(nodes: DataFrame, percent: int) -> DataFrame:
    """One row per node and token: token, node, rank (from 0 in hash order) and the node's other columns but tokens."""
    others = [c for c in nodes.columns if c != "tokens"]
    schema = ", ".join(["token bigint", "rank int", *(f"{c} {t}" for c, t in nodes.select(*others).dtypes)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["tokens"].map(len).to_numpy() // 8
            token = np.frombuffer(b"".join(batch["tokens"]), "<u8").view(np.int64)
            at = np.repeat(np.arange(len(batch)), lengths)
            rank = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield batch[others].iloc[at].assign(token=token, rank=rank.astype(np.int32))
        forget_recent()

    return nodes.mapInPandas(run, schema).select("token", "rank", *others)


def marked(whole: DataFrame) -> DataFrame:
    """node and its marks: 64 * MARKS bits, each whether an odd number of the node's tokens falls on it.

    A token that is in one of two sets only changes one bit, so two nodes are apart by at least the bits that differ.
    """
    number, bit = F.shiftright("token", 6).bitwiseAND(MARKS - 1), F.expr("shiftleft(1L, cast(token & 63 AS int))")
    return whole.groupBy("node").agg(*[F.coalesce(F.bit_xor(F.when(number == k, bit)), F.lit(0)).alias(f"mark{k}") for k in range(MARKS)])


def fits(a: Column, b: Column, percent: int) -> Column:
    """Can sets whose sizes lie in ``a`` and ``b`` (structs low, high) reach the threshold?"""
    return (a["low"] * percent <= b["high"] * 100) & (b["low"] * percent <= a["high"] * 100)


def qualifies(
    mine: tuple[list[np.ndarray], list[int]], theirs: tuple[list[np.ndarray], list[int]], percent: int
) -> bool:
    """Bound: can any document of one group link with any of the other? From the smallest hashes of each.

    Tokens below a hash that both sides know in full and that the other group's union lacks are apart for sure.
    """
    sets, sizes = theirs
    union = np.unique(np.concatenate(sets))
    # below this hash the union is complete for every member that has tokens beyond
    full = min((s[-1] for s, n in zip(sets, sizes, strict=True) if len(s) < n), default=None)
    longest = max(sizes)
    for own, n in zip(*mine, strict=True):
        known = own if full is None else own[: np.searchsorted(own, full, "right")]
        found = np.searchsorted(union, known)
        missing = len(known) - int((union[np.minimum(found, len(union) - 1)] == known).sum())
        if missing <= slack(n, longest, percent):
            return True
    return False


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two whole sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Classes:
    """Union of documents that are known to be connected."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent.setdefault(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)


class Join:
    """The join of one table; ``rows`` (doc_id, n, node) and ``links`` (a, b) between nodes are its results."""

    def __init__(self, docs: DataFrame, percent: int, size: int, key: str, text: str):
        self.docs, self.percent, self.size, self.key, self.text = docs, percent, size, key, text
        sets = token_sets(docs, size, key, text, percent, whole=False)
        found = written(sets.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
        self.rows = written(found.select("doc_id", "n", "node"), "jaccard-rows")
        self.prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        self.nodes = self._nodes(found)
        discard(found)
        matrix = self._matrix()
        near = written(self._opened(self._stars(matrix), self.nodes), "jaccard-links")
        # classes so far; a group is now the part of an old group that lies in one class
        classes = written(components(near).withColumnRenamed("component", "class"), "jaccard-classes")
        placed = self._classed(self.nodes, classes).withColumn("group", F.xxhash64("group", "class"))
        self.links = near.unionByName(self._opened(self._between(matrix, classes, placed), placed))

    @staticmethod
    def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Rows of nodes with their class; a node without links is one of its own."""
        return keyed_join(rows, classes, "node", "left").withColumn("class", F.coalesce("class", "node"))

    def _nodes(self, found: DataFrame) -> DataFrame:
        """node, row and doc_id of its first document, n, group and its smallest hashes (tokens)."""
        rows = found.filter("n > 0 AND doc_id IS NOT NULL")
        several = rows.groupBy("node").agg(F.count("*").alias("_copies"), F.min(F.struct("doc_id", "row"))["row"].alias("_first"))
        several = written(several.filter("_copies > 1").drop("_copies"), "copied-nodes")
        repeated = keyed_join(rows.select("node", "doc_id"), several.select("node"), "node", "left_semi")
        self.repeated = bool(repeated.groupBy("node", "doc_id").count().filter("count > 1").limit(1).count())
        nodes = keyed_join(rows, several, "node").filter("_first IS NULL OR row = _first").drop("_first")
        nodes = nodes.withColumn("lowest", F.substring("tokens", 1, 8))
        sharing = nodes.groupBy("lowest").agg(F.count("*").alias("sharing")).filter(F.col("sharing") > GROUP)
        part = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("sharing", F.lit(1)) / GROUP).cast("bigint"))
        nodes = keyed_join(nodes, written(sharing, "crowded-groups"), "lowest").withColumn("group", F.xxhash64("lowest", part))
        return written(nodes.select("node", "row", "doc_id", "n", "group", "tokens"), "jaccard-nodes")

    def _whole(self, nodes: DataFrame) -> DataFrame:
        """node, n, group and the whole set (tokens), computed again from the texts of the nodes."""
        wanted = written(nodes.select("node", "doc_id", "group"), "wanted-nodes")
        ids = wanted.select(F.col("doc_id").alias(self.key)).distinct()
        chosen = keyed_join(self.docs.select(self.key, self.text), ids, self.key, "left_semi")
        sets = token_sets(chosen, self.size, self.key, self.text, self.percent, whole=True)
        sets = keyed_join(sets, wanted, ["node", "doc_id"], "inner").select("node", "n", "group", "tokens")
        return sets.dropDuplicates(["node"]) if self.repeated else sets

    def _matrix(self) -> DataFrame:
        """The token-group matrix by rows token, rank, node, n, group, for tokens that several nodes have.

        Tokens meet with no more than a row number and a rank; the few that are shared get the rest by the row.
        """
        every = exploded(self.nodes.select("row", "tokens"), self.percent)
        every = every.withColumn("_nodes", F.count("*").over(Window.partitionBy("token"))).filter("_nodes > 1").drop("_nodes")
        return written(every.join(self.nodes.select("row", "node", "n", "group"), "row").drop("row"), "token-groups")

    def _stars(self, matrix: DataFrame) -> DataFrame:
        """Pairs of groups first, second that are worth opening first, and groups of several with themselves.

        Each token of a prefix has two leading groups; a node is paired with a leader that leads a good part of its
        prefix, as it does in a family of near copies. What this leaves out is found later.
        """
        rows = matrix.filter(F.col("rank") < self.prefix)
        leaders = rows.groupBy("token").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).filter("_low < _high")
        rows = rows.join(leaders, "token").withColumn("first", F.explode(F.array("_low", "_high"))).filter("first != group")
        led = rows.groupBy("first", "group", "node", "n").agg(F.count("*").alias("led"))
        pairs = led.filter(F.col("led") * 100 >= LED_PERCENT * self.prefix)
        pairs = pairs.select(F.least("first", "group").alias("first"), F.greatest("first", "group").alias("second")).distinct()
        several = matrix.groupBy("group").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
        several = several.filter("_low < _high").select(F.col("group").alias("first"), F.col("group").alias("second"))
        return pairs.unionByName(several)

    def _between(self, matrix: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
        """Pairs of groups of different classes that share a token of their prefixes, frequent tokens put last.

        Nodes without enough other tokens among their smallest hashes are short: they meet the others by the prefix of
        their whole sets, and each other in an order of their own, tokens of few classes first.
        """
        rows = self._classed(matrix.drop("group"), classes)
        several = rows.groupBy("token").agg(F.min("class").alias("_low"), F.max("class").alias("_high"))
        rows = written(rows.join(several.filter("_low < _high").select("token"), "token"), "token-classes")
        frequent = written(self._crowded(rows), "frequent-tokens")
        flagged = written(keyed_join(rows, frequent, "token", "left_semi").select("node", "n", "rank"), "flagged")
        reserve = F.least(F.col("n"), F.floor(self.prefix * 3 / 2) + 2)
        lost = flagged.groupBy("node", "n").agg(F.count("*").alias("lost"))
        short = lost.filter(reserve - F.col("lost") < F.least(self.prefix, F.col("n"))).select("node")
        short = written(short, "short-nodes")
        whole = self._whole(keyed_join(self.nodes.drop("tokens"), short, "node", "left_semi")).select("node", "n", "tokens")
        whole = written(self._classed(exploded(whole, self.percent), classes), "short-sets")
        # frequent tokens before a token move it up
        rows = keyed_join(rows, frequent, "token", "left_anti").select("node", "n", "rank", "token", "class", F.lit(0).alias("frequent"))
        rows = rows.unionByName(flagged.withColumn("frequent", F.lit(1)), allowMissingColumns=True)
        before = Window.partitionBy("node").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("moved", F.coalesce(F.sum("frequent").over(before), F.lit(0)))
        kept = rows.filter((F.col("frequent") == 0) & (F.col("rank") - F.col("moved") < self.prefix))
        usable = keyed_join(kept, short, "node", "left_anti").select("token", "class")
        order = Window.partitionBy("node").orderBy(F.coalesce(F.col("last"), F.lit(0)), "rank")
        first = keyed_join(whole, frequent.withColumn("last", F.lit(1)), "token").withColumn("_place", F.row_number().over(order))
        first = first.filter((F.col("_place") <= self.prefix) & F.col("last").isNull())
        first = written(first.select("token", "class").distinct(), "short-tokens")
        # what those start with may be further back, and without a mark, in the smallest hashes of the others
        others = keyed_join(placed.select("node", "n", "class", "tokens"), short, "node", "left_anti").drop("node", "n")
        others = keyed_join(exploded(others, self.percent), first.select("token").distinct(), "token", "left_semi")
        usable = written(usable.unionByName(others.select("token", "class")).distinct(), "token-candidates")
        mixed = usable.withColumnRenamed("class", "a").join(first.withColumnRenamed("class", "b"), "token").filter("a != b")
        mixed = mixed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self._met(usable).unionByName(mixed).unionByName(self._met_short(whole))
        pairs = written(pairs.distinct(), "class-pairs")
        sizes = F.struct(F.min("n").alias("low"), F.max("n").alias("high")).alias("sizes")
        groups = written(placed.groupBy("class", "group").agg(sizes), "class-groups")
        one = groups.select(F.col("class").alias("a"), F.col("group").alias("first"), F.col("sizes").alias("_one"))
        two = groups.select(F.col("class").alias("b"), F.col("group").alias("second"), F.col("sizes").alias("_two"))
        met = pairs.join(one, "a").join(two, "b").filter(fits(F.col("_one"), F.col("_two"), self.percent))
        return met.select("first", "second")

    @staticmethod
    def _met(rows: DataFrame) -> DataFrame:
        """Pairs a, b of classes that share a token (rows: token, class, each once; few classes a token).

        Many tokens are shared by the same classes: those pair off once for all of them.
        """
        alike = rows.groupBy("token").agg(F.array_sort(F.collect_list("class")).alias("of")).filter(F.size("of") > 1)
        alike = alike.select("of").distinct().withColumn("a", F.explode("of"))
        return alike.withColumn("b", F.explode("of")).filter("a < b").select("a", "b")

    def _met_short(self, whole: DataFrame) -> DataFrame:
        """Pairs a, b of classes among nodes that have mostly frequent tokens, from their whole sets.

        What comes before the first token that two sets share is in one of them only, and so is the difference of what
        is left from there. That bounds, from place and size alone, which nodes a token of many classes can link; the
        nodes' marks bound it again. So classes meet at such a token only where places, sizes and marks allow a link,
        and not where both have the same token before it: there they have met already.
        """
        classes = whole.select("token", "class").distinct().groupBy("token").agg(F.count("*").alias("classes"))
        order = Window.partitionBy("node").orderBy("classes", "token")
        rows = whole.join(classes, "token").withColumns({"place": F.row_number().over(order) - 1, "before": F.lag("token").over(order)})
        rows = rows.filter((F.col("classes") > 1) & (F.col("place") < self.prefix))
        rows = written(rows.select("token", "before", "node", "class", "place", "n", "classes"), "short-candidates")
        few = rows.filter(F.col("classes") <= 4 * FREQUENT).select("token", "class").distinct()
        many = rows.filter(F.col("classes") > 4 * FREQUENT).join(marked(whole), "node")
        kinds = many.select("token", "place", "n").distinct()
        one, two = (kinds.select("token", F.struct("n", "place").alias(c)) for c in ("_one", "_two"))
        n, m, i, j = F.col("_one.n"), F.col("_two.n"), F.col("_one.place"), F.col("_two.place")

        def near(apart: Column) -> Column:
            return apart * (100 + self.percent) <= (n + m) * (100 - self.percent)

        kinds = one.join(two, "token").filter(near(i + j + F.abs((n - i) - (m - j))) & (F.col("_one") <= F.col("_two")))
        sides = []
        for kind, name in (("_one", "a"), ("_two", "b")):
            marks = [F.col(f"mark{k}").alias(f"{name}{k}") for k in range(MARKS)]
            sides.append(many.select("token", F.struct("n", "place").alias(kind), F.col("class").alias(name), F.col("before").alias(f"{name}_before"), *marks).distinct())
        apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(MARKS)), F.lit(0))
        first = F.col("a_before").isNull() | F.col("b_before").isNull() | (F.col("a_before") != F.col("b_before"))
        once = (F.col("a") != F.col("b")) & ((F.col("_one") != F.col("_two")) | (F.col("a") < F.col("b")))
        many = kinds.join(sides[0], ["token", "_one"]).join(sides[1], ["token", "_two"]).filter(once & first & near(apart))
        return self._met(few).unionByName(many.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    @staticmethod
    def _crowded(rows: DataFrame) -> DataFrame:
        """Tokens of many classes."""
        classes = rows.select("token", "class").distinct().groupBy("token").agg(F.count("*").alias("classes"))
        return classes.filter(F.col("classes") > FREQUENT).select("token")

    def _opened(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links a, b that connect whatever is connected within the paired groups.

        The unions of the smallest hashes bound what can link; a group paired with itself needs no bound. Links
        between documents that earlier links of the same two groups connect are not searched for again.
        """
        percent = self.percent
        pairs = written(pairs, "group-pairs")

        def members(of: DataFrame) -> DataFrame:
            used = of.select(F.col("first").alias("group")).unionByName(of.select(F.col("second").alias("group")))
            return keyed_join(nodes, written(used.distinct(), "used-groups"), "group", "left_semi")

        def sides(of: DataFrame, sets: DataFrame) -> DataFrame:
            lists = sets.groupBy("group").agg(F.collect_list(F.struct("node", "n", "tokens")).alias("docs"))
            one = lists.select(F.col("group").alias("first"), F.col("docs").alias("mine"))
            two = lists.select(F.col("group").alias("second"), F.col("docs").alias("theirs"))
            return of.join(one, "first").join(two, "second")

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for mine, theirs in zip(batch["mine"], batch["theirs"], strict=True):
                    a, b = (([unpacked(d["tokens"]) for d in g], [d["n"] for d in g]) for g in (mine, theirs))
                    keep.append(qualifies(a, b, percent) and qualifies(b, a, percent))
                yield batch[["first", "second"]][np.array(keep, bool)]
            forget_recent()

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                columns = (batch[c] for c in ("first", "second", "mine", "theirs"))
                for first, second, mine, theirs in zip(*columns, strict=True):
                    out = connecting(mine, None if first == second else theirs, percent)
                    if out:
                        yield pd.DataFrame(out, columns=["a", "b"])
            forget_recent()

        between = pairs.filter("first != second")
        between = sides(between, members(between).select("node", "n", "group", "tokens")).mapInPandas(bound, "first bigint, second bigint")
        qualified = written(pairs.filter("first = second").unionByName(between), "qualified-groups")
        opened = sides(qualified, written(self._whole(members(qualified).drop("tokens")), "whole-sets"))
        return opened.mapInPandas(search, "a bigint, b bigint")


def connecting(mine: list, theirs: list | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect all that is connected between two lists of documents, or within one."""
    a, b = ([(d["node"], unpacked(d["tokens"])) for d in g] for g in (mine, theirs if theirs is not None else mine))
    classes, out = Classes(), []
    for i, (x, tokens) in enumerate(a):
        for y, others in b if theirs is not None else b[:i]:
            if classes.root(x) != classes.root(y) and linked(tokens, others, percent):
                classes.join(x, y)
                out.append((x, y))
    return out


def jaccard_components(
    docs: DataFrame, percent: int = 85, size: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when the Jaccard coefficient of their sets of distinct ``size``-word shingles is at least
    ``percent`` / 100; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer words has its whole
    sequence as one shingle. Texts without words, null texts and rows with a null id link with nothing and are their
    own component. Rows that share an id are documents of their own.
    """
    small_batches(docs.sparkSession)
    join = Join(docs, percent, size, key, text)
    classes = components(join.links).select("node", "component")
    done = written(join.rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-done")
    ids = done.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    named = keyed_join(done, ids, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return named
