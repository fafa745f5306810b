"""Ordered operators: day numbers, lagged prices, up flags, first or top rows per key.

No window here runs over a whole ticker. Rows are numbered inside buckets of like size and shifted by
the sizes of the earlier buckets; lags run inside fixed blocks of day numbers that carry the last
few rows of the block before. One ticker may therefore hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.functions import words as W
from marketprose.session import written


def month_bucket(df: DataFrame, order: str) -> Column:
    """Calendar month of a date, a timestamp or ``yyyyMMdd`` text."""
    if dict(df.dtypes)[order] == "string":
        return F.substring(order, 1, 6)
    return F.trunc(order, "month")


def offsets(df: DataFrame, keys: Sequence[str], bucket: str, amount: Column) -> DataFrame:
    """Per key and bucket: ``before``, the total amount in the earlier buckets of that key."""
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).cast("bigint").alias("_amount"))
    return sums.select(
        *keys, bucket, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).cast("bigint").alias("before")
    )


def range_buckets(df: DataFrame, order: Sequence[str | Column], bucket_rows: int | None = None) -> DataFrame:
    """The rows with ``_bucket``, a number that does not decrease with ``order``; buckets are of like size.

    The bounds come from samples of the order's values, whatever their distribution: a value with very many rows is cut by
    the columns after it. Only rows that are equal in all of ``order`` stay together. There are as many buckets as the
    session has shuffle partitions, fewer for little data, or as many as ``bucket_rows`` asks for. The rows are written
    with their bucket, so that it is the same wherever they are read.
    """
    count = [] if bucket_rows is None else [max(1, math.ceil(df.count() / bucket_rows))]
    ranged = df.repartitionByRange(*count, *order)
    return written(ranged.withColumn("_bucket", F.spark_partition_id()), "range-buckets")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows with ``_bucket`` numbered from 1 per key: a row's place in its bucket, after all rows of earlier ones."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    with_before = rows.join(offsets(rows, keys, "_bucket", F.lit(1)), [*keys, "_bucket"])
    return with_before.withColumn(name, (F.col("before") + F.row_number().over(inside)).cast("bigint")).drop("_bucket", "before")


def day_order(
    prices: DataFrame,
    order: str = "datetime",
    by: str = "ticker",
    bucket: Column | None = None,
    tie: Sequence[str] = (),
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add ``day_order``, 1..n in time order per ticker; rows without a ticker are left out.

    Buckets are cut by the data. A caller's ``bucket`` must not decrease with ``order`` (``month_bucket`` suits daily bars)
    and saves the sort by range.
    """
    prices = prices.filter(F.col(by).isNotNull())
    if bucket is None:
        rows = range_buckets(prices, [by, order, *tie, F.xxhash64(*prices.columns)], bucket_rows)
    else:
        rows = prices.withColumn("_bucket", bucket)
    return numbered(rows, [by], [order, *tie], "day_order")


def lag_prices(
    prices: DataFrame,
    lags: Sequence[int] = W.LAGS,
    lag_col: str = "close",
    cur_col: str = "adjclose",
    by: str = "ticker",
    position: str = "day_order",
    block: int = 4096,
) -> DataFrame:
    """Add ``T_minus_k_price`` for each lag, counted in rows, and ``T_price``."""
    reach = max(lags)
    block = max(block, reach)
    home = F.floor((F.col(position) - 1) / block)
    tail = (F.col(position) - 1) % block >= block - reach
    own = F.struct(home.alias("b"), F.lit(True).alias("own"))
    next_block = F.struct((home + 1).alias("b"), F.lit(False).alias("own"))
    copies = prices.withColumn("_c", F.explode(F.when(tail, F.array(own, next_block)).otherwise(F.array(own))))
    blocks = copies.withColumns({"_b": F.col("_c.b"), "_own": F.col("_c.own")}).drop("_c")
    w = Window.partitionBy(by, "_b").orderBy(position)
    lagged = blocks.withColumns({f"T_minus_{k}_price": F.lag(lag_col, k).over(w) for k in lags})
    return lagged.filter("_own").drop("_b", "_own").withColumn("T_price", F.col(cur_col))


def change_flags(prices: DataFrame, lags: Sequence[int] = W.LAGS) -> DataFrame:
    """Add ``change_vs_T_minus_k``: 1 when the price rose, 0 when it fell, stayed or has no history."""
    return prices.withColumns(
        {
            f"change_vs_T_minus_{k}": F.when(F.col("T_price") > F.col(f"T_minus_{k}_price"), 1).otherwise(0)
            for k in lags
        }
    )


def _rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    # Spark cuts each map task to n rows per key before the shuffle, so a hot key costs little
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key; the order should be total."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _rank(df, keys, list(order), 1, "_rn").drop("_rn")


def top_per_group(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of every group, with their rank."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _rank(df, keys, list(order), n, rank)
