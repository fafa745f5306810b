"""Landed raw documents to price, link and article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketprose.operators.ordering import dedup_titles, scan_limit, sort_date_desc
from marketprose.sources.pages import article_pages_to_records
from marketprose.sources.prices import price_chart_to_rows
from marketprose.sources.search import items_to_links, search_batches_to_items


def ingest_prices(charts: DataFrame) -> DataFrame:
    """Bars of all landed charts (ticker, body) in one table."""
    return price_chart_to_rows(charts)


def ingest_links(pages: DataFrame, feed: str = "articles", sort: bool = False) -> DataFrame:
    """Links of all landed search pages (query, query_pos, page_start, body), each once.

    ``sort`` puts the latest first; it is a full sort, of use for a file to read and no more.
    """
    links = items_to_links(search_batches_to_items(pages), feed)
    return sort_date_desc(links, parse=False) if sort else links


def ingest_articles(pages: DataFrame, links: DataFrame, limit: int | None = None, **join) -> DataFrame:
    """Articles of the landed pages (link, html) whose link is in the table, each title once."""
    wanted = links if limit is None else scan_limit(links, "link", limit)
    return dedup_titles(article_pages_to_records(pages, wanted, how="inner", **join))
