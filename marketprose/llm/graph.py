"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketprose.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component, the smallest node reachable, for every node that has a link to another one.

    Large-star and small-star steps by joins and partial minima: each hangs the larger neighbours of a node, then the
    smaller ones, on the smallest, until the links are a forest of stars. Every step is written to the shared
    folder. Nulls, self-links and repeated links are ignored; no links give no rows.
    """
    edges = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    edges = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("low") < F.col("high"))).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = state
        ends = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = ends.groupBy("low").agg(F.least(F.min("high"), F.first("low")).alias("least"))
        large = edges.join(least, "low").select(F.col("least").alias("low"), "high").distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(smallest, "high").select(F.col("least").alias("low"), F.col("low").alias("high"))
        small = small.filter("low < high").unionByName(smallest.select(F.col("least").alias("low"), "high")).distinct()
        edges = written(small, "links")
