"""Search pages that land over time: every link comes out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marketprose.functions.text import bind, to_text
from marketprose.operators.select import once
from marketprose.sources import schemas
from marketprose.sources.search import page_json


RECENT = ("landed_at", "30 days")  # search results name the same links for some weeks


def stream_pages(
    spark: SparkSession, path: str, files_per_batch: int | None = None, whole_files: bool = True
) -> DataFrame:
    """Landed pages as a stream (``body``, ``landed_at``, the time of its file): one page per file, or one per line."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = reader.text(path, wholetext=whole_files)
    return text.select(F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("landed_at"))


def page_links(items: Column, feed: str) -> Column:
    """The items of a page that are articles with a link, each link once."""
    trimmed = F.transform(
        F.filter(items, lambda i: i["feedname"] == feed),
        lambda i: F.struct(to_text(i["link"]).alias("link"), to_text(i["title"]).alias("title"), i["pubdate"].alias("pubdate")),
    )

    def first_ones(kept: Column) -> Column:
        links = F.transform(kept, lambda i: i["link"])
        return bind(links, lambda l: F.filter(kept, lambda i, pos: F.array_position(l, i["link"]) == pos + 1))

    return bind(F.filter(trimmed, lambda i: i["link"] != ""), first_ones)


def new_links(pages: DataFrame, feed: str = "articles", within: tuple[str, str] | None = None) -> DataFrame:
    """Links not seen before (link, title, pubdate), in order of arrival.

    Repeats inside a page go before the shuffle, so a link in every item costs one row per page.
    ``within`` = (time column, delay), such as ``RECENT``, bounds the state: a link is forgotten once the newest time seen
    is two delays past its first one, and comes out again if it lands after that; rows that are later than the delay are
    left out. Without it every link is kept for ever.
    """
    parsed = F.from_json(page_json(F.col("body")), schemas.SEARCH_PAGE)["items"]
    carried = [within[0]] if within else []
    items = pages.select(*carried, F.explode(F.array(parsed)).alias("items")).filter(F.col("items").isNotNull())
    links = once(items, "links", page_links(F.col("items"), feed))
    rows = links.select(*carried, F.inline("links"))
    if within:
        return rows.withWatermark(*within).dropDuplicatesWithinWatermark(["link"]).drop(within[0])
    return rows.dropDuplicates(["link"])


def write_new_links(links: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed, append to Parquet, remember progress and seen links in ``checkpoint``."""
    return (
        links.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
