"""News search result pages: JSON wrapped in a callback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions.dates import coerce_date, human_date_to_iso
from marketprose.functions.text import to_text
from marketprose.operators.ordering import dedup_links
from marketprose.operators.select import filter_feed, once
from marketprose.sources import schemas

CALLBACK = r"(?s)callback\((.*)\)"


def page_json(body: Column) -> Column:
    """The JSON text inside the callback; null without one."""
    found = F.regexp_extract(body, CALLBACK, 1)
    return F.when(found != "", found)


def search_pages(pages: DataFrame) -> DataFrame:
    """Pages with their parsed ``items`` and ``total``; both are null where the page is malformed."""
    parsed = F.from_json(page_json(F.col("body")), schemas.SEARCH_PAGE)
    return once(pages, "_p", parsed).withColumns(
        {"items": F.col("_p.items"), "total": F.col("_p.metadata.total")}
    ).drop("_p", "body")


def malformed_pages(pages: DataFrame) -> DataFrame:
    """Landed pages that hold no readable result."""
    return pages.filter(F.from_json(page_json(F.col("body")), schemas.SEARCH_PAGE)["items"].isNull())


def search_batches_to_items(pages: DataFrame) -> DataFrame:
    """One row per item: query columns, ``item_pos`` on the page, feedname, link, title, pubdate, total."""
    parsed = search_pages(pages)
    keep = [c for c in parsed.columns if c != "items"]
    return parsed.select(*keep, F.posexplode("items").alias("item_pos", "_i")).select(
        *keep, "item_pos", "_i.feedname", "_i.link", "_i.title", "_i.pubdate"
    )


def items_to_links(items: DataFrame, feed: str = "articles") -> DataFrame:
    """Articles found: one row per link with title, date and the query that found it first.

    ``date`` is a day; what cannot be read as one is null.
    """
    kept = dedup_links(filter_feed(items, feed))
    return kept.select(
        to_text(F.col("title")).alias("title"),
        coerce_date(human_date_to_iso(to_text(F.col("pubdate")))).alias("date"),
        "link",
        "query",
    )
