"""Landed raw documents to tables, files in and out, the link stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from marketprose.functions.dates import coerce_date
from marketprose.functions.text import collapse_whitespace
from marketprose.operators import select as S
from marketprose.operators.lookups import link_pages
from marketprose.queries import inputs as I
from marketprose.queries import sqlparts as P
from marketprose.queries.registry import query
from marketprose.session import scratch_path
from marketprose.sources import pages as PG
from marketprose.sources import prices as PR
from marketprose.sources import search as SE
from marketprose.sources import tables as TB
from marketprose.streaming import links as ST

ARTICLE_FILE = "doc_id bigint, link string, title string, date string, author string, content string"


@query("read_table_csv", P.with_articles("SELECT doc_id, link, title, date, author, content FROM articles"))
def read_table_csv(spark, sf_dir):
    """All articles through a CSV file with quotes and line breaks."""
    path = scratch_path(spark, "articles-csv")
    columns = ["doc_id", "link", "title", "date", "author", "content"]
    TB.write_table(I.articles(spark, sf_dir).select(*columns), path, "csv")
    return TB.read_table_csv(spark, path, ARTICLE_FILE)


@query(
    "write_table",
    P.with_articles(
        f"SELECT doc_id, content, {P.split_case('try_cast(date AS DATE)')} AS split FROM articles"
    ),
)
def write_table(spark, sf_dir):
    """All articles written by split and read back."""
    path = scratch_path(spark, "articles-split")
    labelled = I.articles(spark, sf_dir).select(
        "doc_id", "content", S.split_label(coerce_date(F.col("date"))).alias("split")
    )
    TB.write_table(labelled, path, partition_by=["split"])
    return spark.read.parquet(path)


@query(
    "price_chart_to_rows",
    P.with_prices(
        """SELECT ticker, strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, adjclose, volume, datetime,
        CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, 'daily_price' AS table_name FROM prices"""
    ),
)
def price_chart_to_rows(spark, sf_dir):
    rows = PR.price_chart_to_rows(I.price_charts(spark, sf_dir))
    return rows.withColumn("ts", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query(
    "search_batches_to_items",
    P.with_items(
        """SELECT query_pos, page_start, CAST(row_number() OVER (PARTITION BY query_pos, page_start ORDER BY item_id) - 1 AS INT) AS item_pos,
        feedname, link, title, pubdate, CAST(count(*) OVER (PARTITION BY query_pos, page_start) AS BIGINT) AS total FROM search_items"""
    ),
)
def search_batches_to_items(spark, sf_dir):
    items = SE.search_batches_to_items(I.search_pages(spark, sf_dir))
    return items.select("query_pos", "page_start", "item_pos", "feedname", "link", "title", "pubdate", "total")


@query("malformed_pages", "SELECT CAST(page_id AS INT) AS page_start FROM pages")
def malformed_pages(spark, sf_dir):
    return SE.malformed_pages(I.search_pages(spark, sf_dir)).select("page_start")


_AUTHOR = I.AUTHOR_NAME
_CONTENT = P.strip("text")


@query(
    "article_pages_to_records",
    f"""SELECT concat('https://news.example.com/', CAST(doc_id AS VARCHAR)) AS link,
    {P.strip("CASE WHEN lang = 'fr' THEN '' ELSE split_part(text, '.', 1) END")} AS title,
    CASE WHEN lang = 'de' THEN '' ELSE CAST(n_chars AS VARCHAR) END AS date, {_AUTHOR} AS author, {_CONTENT} AS content
    FROM documents WHERE lang <> 'es'""",
)
def article_pages_to_records(spark, sf_dir):
    return PG.article_pages_to_records(I.article_pages(spark, sf_dir))


@query(
    "jsonld_fallbacks",
    P.with_articles(
        f"""SELECT a.link, {P.strip("CASE WHEN lang = 'fr' THEN title ELSE split_part(text, '.', 1) END")} AS title,
        CASE WHEN lang = 'de' THEN date ELSE CAST(n_chars AS VARCHAR) END AS date
        FROM articles a JOIN documents d ON a.doc_id = d.doc_id WHERE lang <> 'es'"""
    ),
)
def jsonld_fallbacks(spark, sf_dir):
    """Headlines and dates that pages lack, from the link table."""
    records = PG.article_pages_to_records(I.article_pages(spark, sf_dir), I.articles(spark, sf_dir))
    return records.select("link", "title", "date")


@query("clean_author", f"SELECT doc_id, {_AUTHOR} AS author FROM documents")
def clean_author(spark, sf_dir):
    """Authors as they stand in the page's JSON."""
    return I.table(spark, sf_dir, "documents").select("doc_id", PG.clean_author(F.expr(I.AUTHOR_JSON)).alias("author"))


@query(
    "link_page_join",
    P.with_articles("SELECT p.url AS link, a.title FROM (SELECT url FROM pages UNION ALL SELECT link FROM articles) p LEFT JOIN articles a ON p.url = a.link"),
)
def link_page_join(spark, sf_dir):
    articles = I.articles(spark, sf_dir)
    urls = I.table(spark, sf_dir, "pages").select(F.col("url").alias("link")).union(articles.select("link"))
    return link_pages(urls, articles.select("link", "title"), spread=["link"], max_bytes=0, hot_rows=50)


@query(
    "search_links",
    P.with_items(
        """SELECT trim(link) AS link, trim(title, ' \n') AS title, query_pos,
        CAST(coalesce(try_strptime(pubdate, '%b %d, %Y'), try_strptime(pubdate, '%B %d, %Y')) AS DATE) AS date
        FROM (SELECT *, row_number() OVER (PARTITION BY trim(link) ORDER BY query_pos, page_start, item_id) AS rn
          FROM search_items WHERE feedname = 'articles' AND trim(link) <> '') WHERE rn = 1""".replace("trim(title, ' \n')", P.to_text("title"))
    ),
)
def search_links(spark, sf_dir):
    links = SE.items_to_links(SE.search_batches_to_items(I.search_pages(spark, sf_dir)))
    terms = F.array(*[F.lit(t) for t in I.SEARCH_TERMS])
    return links.select("link", "title", (F.array_position(terms, F.col("query")) - 1).cast("int").alias("query_pos"), "date")


_NEW_LINKS = P.with_items("SELECT DISTINCT trim(link) AS link FROM search_items WHERE feedname = 'articles' AND trim(link) <> ''")


def _landed(spark, pages, path):
    pages.select(collapse_whitespace(F.col("body"))).write.mode("append").text(path)


@query("stream_new_links", _NEW_LINKS)
def stream_new_links(spark, sf_dir):
    """All landed pages as a stream with bounded state, one page per line, read until none is left."""
    landed, out = scratch_path(spark, "landed-pages"), scratch_path(spark, "new-links")
    _landed(spark, I.search_pages(spark, sf_dir), landed)
    stream = ST.new_links(ST.stream_pages(spark, landed, whole_files=False), within=ST.RECENT)
    ST.write_new_links(stream, os.path.join(out, "rows"), os.path.join(out, "checkpoint")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "rows")).select("link")


@query("stream_links_restarted", _NEW_LINKS)
def stream_links_restarted(spark, sf_dir):
    """The same links when pages land in two parts that share links, with a restart between them, in small batches."""
    landed, out = scratch_path(spark, "landed-pages"), scratch_path(spark, "new-links")
    rows, state = os.path.join(out, "rows"), os.path.join(out, "checkpoint")
    pages = I.search_pages(spark, sf_dir)
    for part in (pages.filter("query_pos % 2 = 0"), pages):  # the second brings the pages of the first again
        _landed(spark, part, landed)
        stream = ST.new_links(ST.stream_pages(spark, landed, files_per_batch=4, whole_files=False), within=ST.RECENT)
        ST.write_new_links(stream, rows, state).awaitTermination()
    return spark.read.parquet(rows).select("link")
