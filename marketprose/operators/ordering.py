"""Sorts, limits and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketprose.functions.dates import coerce_date
from marketprose.operators.windows import first_per_key


def dedup_links(items: DataFrame) -> DataFrame:
    """One row per link: the earliest by query, page and place on the page."""
    return first_per_key(items, "link", ["query_pos", "page_start", "item_pos"])


def dedup_titles(articles: DataFrame) -> DataFrame:
    """One row per title: the latest by date text, then by link."""
    return first_per_key(articles, "title", [F.col("date").desc_nulls_last(), F.col("link")])


def sort_date_desc(df: DataFrame, column: str = "date", parse: bool = True, tie: str = "link") -> DataFrame:
    """Latest first, unreadable dates last.

    The tie column also spreads rows of one date over several sort partitions.
    """
    key = coerce_date(F.col(column)) if parse else F.col(column)
    return df.orderBy(key.desc_nulls_last(), F.col(tie))


def sort_chronological(df: DataFrame, column: str = "datetime", tie: str = "ticker") -> DataFrame:
    return df.orderBy(column, tie)


def scan_limit(links: DataFrame, key: str, limit: int, column: str = "link") -> DataFrame:
    """The first ``limit`` rows by key, less those without a link."""
    return links.orderBy(key).limit(limit).filter(F.col(column).isNotNull() & (F.col(column) != ""))


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
