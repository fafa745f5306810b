"""Equi-joins to tables with one row per key: word lists, lexicons, term dictionaries, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketprose.operators.select import unnest
from marketprose.session import written

MAX_BROADCAST_BYTES = 64 << 20
HOT_ROWS = 4_000_000
MAX_HOT_KEYS = 100_000
NULL_SHARDS = 1024


def _width(field: T.StructField) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        inner = F.octet_length(F.concat_ws("", col)) if field.dataType.elementType == T.StringType() else F.lit(0)
        return F.coalesce(inner + 8 * F.size(col), F.lit(0)) + 16
    return F.lit(16)


def table_bytes(df: DataFrame) -> int:
    """Size of the rows in memory, from one small aggregation."""
    total = df.agg(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("bigint"))).first()[0]
    return int(total or 0)


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return table_bytes(df) <= max_bytes


def salted_join(
    big: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffled join that splits every key holding more than ``hot_rows`` rows of ``big``.

    Rows of a hot key are dealt over shards by a hash of ``spread``; only the hot rows of ``dim``
    are repeated, once per shard. Where there are very many keys of that size, those above a
    ``MAX_HOT_KEYS``-th of their rows count as hot, so that the list is short by arithmetic.
    """
    keys = list(keys)
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    counts = written(counts, "hot-keys")
    least = max(hot_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // MAX_HOT_KEYS)
    hot = counts.filter(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_shards"))
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    missing = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0
    shards = F.when(missing, F.lit(NULL_SHARDS)).otherwise(F.coalesce("_shards", F.lit(1)))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_shard", F.pmod(F.xxhash64(*spread), shards).cast("int"))
        .drop("_shards")
    )
    right = (
        dim.join(hot, keys, "left")
        .withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce("_shards", F.lit(1)) - 1)))
        .drop("_shards")
    )
    return left.join(right, [*keys, "_shard"], how).drop("_shard")


def keyed_join(
    big: DataFrame,
    dim: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join to ``dim``, which has one row per key: broadcast when its measured size allows, else salted."""
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits_broadcast(dim, max_bytes):
        return big.join(F.broadcast(dim), keys, how)
    return salted_join(big, dim, keys, how, spread or big.columns, hot_rows)


def word_table(spark: SparkSession, words: Sequence[str], column: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"{column} string")


def mapping_table(spark: SparkSession, mapping: Mapping[str, object], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), ddl)


def explode_tokens(df: DataFrame, tokens: Column, *keep: str, together: bool = False) -> DataFrame:
    """One row per token: the kept columns, ``pos`` from 0, ``token``.

    ``together`` moves the rows by the first kept column before they are taken apart, so that putting
    the tokens back together needs no shuffle: texts are smaller than their token rows.
    """
    if together:
        df = df.repartition(keep[0])
    return unnest(df, keep, tokens, "pos", "token")


def drop_stopwords(tokens: DataFrame, stops: DataFrame, column: str = "token", **join) -> DataFrame:
    """Token rows whose word is not in the stop table (column ``word``)."""
    stops = stops.select(F.col("word").alias(column)).distinct()
    return keyed_join(tokens, stops, column, "left_anti", **join)


def lexicon_join(tokens: DataFrame, lexicon: DataFrame, column: str = "token", **join) -> DataFrame:
    """Token rows with the lexicon's columns, null for unlisted words.

    ``lexicon`` is keyed by ``word``; of repeated words the smallest row counts.
    """
    values = [c for c in lexicon.columns if c != "word"]
    one = lexicon.groupBy("word").agg(F.min(F.struct(*values)).alias("_v"))
    one = one.select(F.col("word").alias(column), *[F.col(f"_v.{v}").alias(v) for v in values])
    return keyed_join(tokens, one, column, "left", **join)


def regroup_tokens(tokens: DataFrame, doc: str, value: Column, out: str = "tokens") -> DataFrame:
    """Token rows back to one ordered array per document; a group is one document's tokens."""
    pairs = F.collect_list(F.struct(F.col("pos").alias("p"), value.alias("v")))
    return tokens.groupBy(doc).agg(F.transform(F.array_sort(pairs), lambda s: s["v"]).alias(out))


def link_pages(pages: DataFrame, links: DataFrame, url: str = "link", how: str = "left", **join) -> DataFrame:
    """Pages with their row of the link table, where there is one; ``links`` has one row per url."""
    return keyed_join(pages, links, url, how, **join)
