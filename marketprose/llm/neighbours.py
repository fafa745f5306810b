"""Embedding near-duplicates by NN-descent.

Equal vectors become one node. A first neighbour graph comes from the leaves of random-projection trees; then
neighbours of neighbours are compared and the best kept, until a round finds no further link. Nodes whose list is full
of links have more than the list shows. Such nodes get further lists, of neighbours outside their component only; a
link found there joins the two components, and lists begin anew until no node of a full list has a link to the
outside. Inside the components lists are not enlarged: all pairs are compared in blocks, so that links are counted
without a pair ever being stored. The recall of links is audited against brute force on a sample; below the goal more
trees and rounds follow.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.llm.common import as_key, dealt, frames, keyed
from marketprose.llm.graph import components
from marketprose.operators.lookups import keyed_join
from marketprose.session import written

LEAF = 256
CHUNK = 64  # members of a centre that are compared with each other at once
BLOCK = 512
AUDIT = 16  # the sample of the audit grows to so many times its size when links are rare

log = logging.getLogger(__name__)


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def unit_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, space (label and vector length), digest, unit (doubles) per row; the last three null where it can't link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, name, values in zip(batch["k"], batch["label"], batch["v"], strict=True):
                usable = k is not None and name is not None and values is not None
                x = np.array([np.nan if c is None else c for c in values] if usable else [], np.float64) + 0.0
                norm = np.linalg.norm(x / (np.abs(x).max() or 1.0)) if len(x) and np.isfinite(x).all() else 0.0
                if norm > 0:
                    x = x / np.abs(x).max()
                    out.append((k, f"{len(x)}:{name}", hashlib.sha256(x.tobytes()).hexdigest(), (x / norm).tobytes()))
                else:
                    out.append((k, None, None, None))
            yield pd.DataFrame(out, columns=["vec_id", "space", "digest", "unit"])

    chosen = rows.select(as_key(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    return keyed(chosen.mapInPandas(run, "vec_id string, space string, digest string, unit binary"), "vec_id")


def leaf_edges(nodes: DataFrame, sizes: DataFrame, tree: int, k: int) -> DataFrame:
    """node, other, cos: the ``k`` nearest of each node in its leaf of one random-projection tree, of other families."""

    @F.pandas_udf("code bigint, along double")
    def project(units: pd.Series, bits: pd.Series) -> pd.DataFrame:
        code, along = np.zeros(len(units), np.int64), np.zeros(len(units))
        for width, rows in units.groupby(units.map(len)).groups.items():
            at = units.index.get_indexer(rows)
            x = matrix(units.iloc[at], "<f8")
            planes = np.random.default_rng([tree, width]).standard_normal((x.shape[1], 41))
            side = x @ planes
            use = bits.to_numpy(np.int64)[at][:, None] > np.arange(40)[None, :]
            code[at] = (((side[:, :40] > 0) & use) << np.arange(40)).sum(1)
            along[at] = side[:, 40]
        return pd.DataFrame({"code": code, "along": along})

    bits = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("nodes") / (LEAF // 2)))))
    placed = nodes.join(sizes, "space").withColumn("p", project("unit", bits.cast("int")))
    order = Window.partitionBy("space", "p.code").orderBy("p.along", "node")
    run = F.floor((F.row_number().over(order) - 1) / LEAF)
    leaves = placed.select("node", "unit", F.xxhash64("space", "p.code", run, F.lit(tree)).alias("leaf"), "space", family(nodes))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in groups(batches, "leaf"):
            for _, rows in found.groupby("space", sort=False):
                yield from best_pairs(rows["node"].to_numpy(), matrix(rows["unit"], "<f8"), None, k, rows["family"].to_numpy())

    return dealt(leaves, "leaf").sortWithinPartitions("leaf").mapInPandas(nearest, "node bigint, other bigint, cos double")


def family(nodes: DataFrame) -> Column:
    """The family of a node, whose members are not compared with it; without families each node is its own."""
    return F.col("family" if "family" in nodes.columns else "node").alias("family")


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Whole groups of rows sorted by ``key``; a group may span batches."""
    held: list[pd.DataFrame] = []
    current = None
    for value, rows in frames(batches, key):
        if held and value != current:
            yield current, pd.concat(held) if len(held) > 1 else held[0]
            held = []
        current = value
        held.append(rows)
    if held:
        yield current, pd.concat(held) if len(held) > 1 else held[0]


def best_pairs(ids: np.ndarray, units: np.ndarray, worst: np.ndarray | None, k: int, families: np.ndarray) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest of other families of each row, where they are nearer than its worst neighbour so far."""
    if len(ids) < 2:
        return
    cos = units @ units.T
    cos[families[:, None] == families[None, :]] = -2
    top = np.argpartition(-cos, min(k, len(ids) - 1) - 1, axis=1)[:, :k]
    value = np.take_along_axis(cos, top, 1)
    use = value > (np.full(len(ids), -2.0) if worst is None else worst)[:, None]
    row, col = np.nonzero(use)
    yield pd.DataFrame({"node": ids[row], "other": ids[top[row, col]], "cos": value[row, col]})


def keep_best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("node", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cos"), "other"))
    return once.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def refined(graph: DataFrame, nodes: DataFrame, k: int, salt: int, known: DataFrame | None = None) -> DataFrame:
    """One round of NN-descent: the members around each centre are compared with each other.

    ``known`` are further neighbours that lead to members; they do not enter the lists.
    """
    ways = graph.select("node", "other") if known is None else graph.select("node", "other").unionByName(known.select("node", "other"))
    both = ways.select(F.col("node").alias("centre"), F.col("other").alias("member")).unionByName(
        ways.select(F.col("other").alias("centre"), F.col("node").alias("member"))
    )
    both = both.distinct()
    # a centre that many nodes name is dealt out in chunks
    order = Window.partitionBy("centre").orderBy(F.xxhash64("member", F.lit(salt)), "member")
    both = both.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK))
    full = graph.groupBy("node").agg(F.min("cos").alias("worst"), F.count("*").alias("n"))
    full = full.select(F.col("node").alias("member"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).alias("worst"))
    units = nodes.select(F.col("node").alias("member"), "unit", family(nodes)).join(full, "member", "left")
    joined = both.join(units, "member").select(
        F.xxhash64("centre", "chunk").alias("at"), "centre", "member", "unit", "family", F.coalesce("worst", F.lit(-2.0)).alias("worst")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in groups(batches, "at"):
            for _, rows in found.groupby("centre", sort=False):
                pairs = (rows["member"].to_numpy(), matrix(rows["unit"], "<f8"), rows["worst"].to_numpy())
                yield from best_pairs(*pairs, k, rows["family"].to_numpy())

    near = dealt(joined, "at").sortWithinPartitions("at")
    return keep_best(graph.unionByName(near.mapInPandas(compare, "node bigint, other bigint, cos double")), k)


def joined(graph: DataFrame, nodes: DataFrame, threshold: float, k: int, trees: int, planted: int) -> tuple[DataFrame, DataFrame]:
    """node, component of all nodes that have links; and the links.

    A link that neither end has in its list is one between two full lists. The nodes of full lists are therefore searched
    again among themselves for the nearest outside their own component. Each link found joins two components; then
    the lists and trees begin anew, until lists that no longer get nearer hold no link.
    """
    links = graph.filter(F.col("cos") >= threshold)
    membership = written(components(links, "node", "other"), "vector-components")
    full = links.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select("node")
    crowded = written(nodes.join(full, "node"), "crowded-nodes")
    sizes = crowded.groupBy("space").agg(F.count("*").alias("nodes"))
    inside = links.join(full, "node").select("node", "other")
    for first in itertools.count(planted, trees):
        apart = written(crowded.join(membership, "node").withColumnRenamed("component", "family"), "crowded-nodes")
        if apart.agg(F.min("family") == F.max("family")).first()[0] in (None, True):
            return membership, links
        near = [leaf_edges(apart, sizes, tree, k) for tree in range(first, first + trees)]
        across = written(keep_best(functools.reduce(DataFrame.unionByName, near), k), "vector-across")
        reached = 0.0
        while True:
            nearness, found = across.agg(F.sum(F.col("cos") + 1), F.sum((F.col("cos") >= threshold).cast("int"))).first()
            if found or (nearness or 0) <= reached * 1.001:
                break
            reached = nearness
            across = written(refined(across, apart, k, first, inside), "vector-across")
        if not found:
            return membership, links
        more = across.filter(F.col("cos") >= threshold)
        links = links.unionByName(more)
        one, two = (membership.select(F.col("node").alias(end), F.col("component").alias(f"{end}_family")) for end in ("node", "other"))
        pairs = more.join(one, "node").join(two, "other")
        merged = components(pairs, "node_family", "other_family").select(F.col("node").alias("component"), F.col("component").alias("into"))
        whole = membership.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        membership = written(whole, "vector-components")
    raise AssertionError


def audit(membership: DataFrame, nodes: DataFrame, threshold: float, sample: int) -> float:
    """Share of the sampled nodes' true links that lie inside one component, where all links are found.

    The sample is ``sample`` nodes, by hash, compared with all others; it is doubled until it has at least ``sample``
    links, or is all nodes or ``AUDIT`` times as large.
    """
    for times in itertools.takewhile(lambda n: n <= AUDIT, (1 << n for n in itertools.count())):
        true, hits = _audited(membership, nodes, threshold, sample * times)
        if true >= sample or sample * times >= nodes.count():
            break
    return hits / true if true else 1.0


def _audited(membership: DataFrame, nodes: DataFrame, threshold: float, sample: int) -> tuple[int, int]:
    """Links of the sampled nodes, and how many of them lie inside one component."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["space"], bytes(r["unit"])) for r in chosen])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = pd.DataFrame(shared.value, columns=["node", "space", "unit"])
        for batch in batches:
            for space, rows in batch.groupby("space"):
                mine = queries[queries["space"] == space]
                if len(mine):
                    cos = matrix(mine["unit"], "<f8") @ matrix(rows["unit"], "<f8").T
                    a, b = np.nonzero(cos >= threshold)
                    yield pd.DataFrame({"node": mine["node"].to_numpy()[a], "other": rows["node"].to_numpy()[b]})

    true = nodes.select("node", "space", "unit").mapInPandas(search, "node bigint, other bigint").filter("node != other")
    one = membership.select("node", F.col("component").alias("one"))
    two = membership.select(F.col("node").alias("other"), F.col("component").alias("two"))
    hit = (F.col("one") == F.col("two")).cast("int")
    got = true.join(one, "node", "left").join(two, "other", "left").agg(F.count("*"), F.sum(hit)).first()
    return got[0], got[1] or 0


def counted(nodes: DataFrame, membership: DataFrame, threshold: float) -> DataFrame:
    """node, linked: vectors in other nodes that link with it, for all nodes of components with two or more.

    Every component is cut into blocks of nodes; each pair of blocks is compared by one task, which gives one number
    per node.
    """
    inside = nodes.join(membership, "node").select("node", "component", "n", "unit")
    order = Window.partitionBy("component").orderBy("node")
    inside = inside.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    blocks = membership.groupBy("component").agg((F.floor((F.count("*") - 1) / BLOCK)).cast("int").alias("last"))
    placed = inside.join(blocks, "component").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    left = placed.select("component", F.col("block").alias("i"), F.col("with").alias("j"), "node", "n", "unit", F.lit(True).alias("left"))
    right = placed.select("component", F.col("with").alias("i"), F.col("block").alias("j"), "node", "n", "unit", F.lit(False).alias("left"))
    pairs = left.unionByName(right).withColumn("at", F.xxhash64("component", "i", "j"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in groups(batches, "at"):
            for _, rows in found.groupby(["component", "i", "j"], sort=False):
                side = rows["left"].to_numpy(bool)
                one, two = rows[side], rows[~side]
                near = matrix(one["unit"], "<f8") @ matrix(two["unit"], "<f8").T >= threshold
                near &= one["node"].to_numpy()[:, None] != two["node"].to_numpy()[None, :]
                yield pd.DataFrame({"node": one["node"].to_numpy(), "linked": near @ two["n"].to_numpy(np.int64)})

    parts = dealt(pairs, "at").sortWithinPartitions("at", "component", "i", "j")
    return parts.mapInPandas(count, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


@dataclass
class NearVectors:
    """``vectors``: vec_id, n_links, component_id, kept per row; ``links``: node, other, cos; ``recall`` of the audit."""

    vectors: DataFrame
    links: DataFrame
    recall: float


def near_vectors(
    rows: DataFrame,
    threshold: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    k: int = 8,
    trees: int = 4,
    goal: float = 0.99,
    sample: int = 200,
    max_rounds: int = 12,
) -> NearVectors:
    """Near-duplicates among vectors with equal labels and equal lengths.

    Null labels, null or empty vectors, zero vectors, and null, NaN or infinite components link with nothing; neither
    do rows with a null key. Equal vectors (also after scaling) are one node with a number of its own; every row is a
    vector of its own, also when it repeats a key. ``sample`` nodes are audited against all; rounds go on until none
    finds a link and recall meets ``goal``. The result tells the recall; a RuntimeError says that ``max_rounds`` did not
    suffice.
    """
    units = written(unit_vectors(rows, key, vector, label), "vectors")
    usable = units.filter("digest IS NOT NULL")
    nodes = usable.groupBy("space", "digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.min("unit").alias("unit"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy("space").agg(F.count("*").alias("nodes"))
    graph = membership = None
    recall = found = planted = 0
    for turn in range(max_rounds):
        if graph is None or membership is not None:  # at first, and after an audit that was not good enough
            for tree in range(planted, planted + trees):
                near = leaf_edges(nodes, sizes, tree, k)
                graph = near if graph is None else graph.unionByName(near)
            planted += trees
            graph = written(keep_best(graph, k), "vector-graph")
        graph = written(refined(graph, nodes, k, turn), "vector-graph")
        links = graph.filter(F.col("cos") >= threshold)
        before, found = found, links.count()
        if turn and found <= before * 1.001 or turn == max_rounds - 1:
            membership, links = joined(graph, nodes, threshold, k, trees, planted)
            recall = audit(membership, nodes, threshold, sample)
            if recall >= goal:
                break
            log.warning("recall of links is %.4f after %d rounds, the goal is %.4f", recall, turn + 1, goal)
    if recall < goal:
        raise RuntimeError(f"recall of links is {recall:.4f} after {max_rounds} rounds, the goal is {goal}")
    more = counted(nodes, membership, threshold)
    classes = nodes.select("space", "digest", "node", "n", "first").join(membership, "node", "left").join(more, "node", "left")
    named = classes.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("smallest"))
    done = keyed_join(classes, named, "component").select(
        "space", "digest", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("smallest", "first").alias("component_id"),
    )
    linked = keyed_join(usable.select("vec_id", "space", "digest"), done, ["space", "digest"], "inner")
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = units.filter("digest IS NULL")
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return NearVectors(result, links, recall)
