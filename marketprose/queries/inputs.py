"""The operators' input tables, derived from the given tables.

Each derivation is one SQL text that Spark and the checking database both read; the raw documents
(JSON, JSONP, HTML) are then packed with Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketprose.functions.words import SEARCH_TERMS
from marketprose.sources.tables import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# every 97th date cannot be read, every 89th text is missing, every fifth carries names and marks;
# dates lie 53 days apart, so that some months are empty
ARTICLES = """
SELECT doc_id, concat('https://news.example.com/', CAST(doc_id AS VARCHAR(20))) AS link,
       split_part(text, '.', 1) AS title,
       CASE WHEN doc_id % 97 = 0 THEN 'not a date'
            ELSE CAST(DATE '2011-10-01' + CAST(((doc_id * 37) % 100) * 53 AS INT) AS VARCHAR(10)) END AS date,
       source AS author,
       CASE WHEN doc_id % 89 = 0 THEN NULL
            WHEN doc_id % 5 = 0 THEN concat(text, ' Elon  Musk', chr(39), 's Tesla cars are amazing! The ROCKET was not very good, ',
                 'but NASA won', chr(39), 't worry: best batteries. Visit https://tesla.com/x, mail a.b@mail.org; 3.5 U.S. sales, 100 more??')
            ELSE text END AS content
FROM documents
"""

POSTS = """
SELECT conv_id * 1000 + turn AS post_id,
       concat(text, CASE WHEN (conv_id + turn) % 5 = 0
                         THEN ' https://t.co/Ab1 @user_1 $TSLA 100m 5% 🚀漢字 don' ELSE '' END,
              CASE WHEN (conv_id + turn) % 5 = 0 THEN concat(chr(39), 't worry') ELSE '' END) AS "fullText",
       role
FROM conversations
"""

PRICES = """
SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d,
       min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
       max_by(o_totalprice, o_orderkey) AS close,
       (min_by(o_totalprice, o_orderkey) + max_by(o_totalprice, o_orderkey)) / 2 AS adjclose,
       CAST(count(*) AS BIGINT) AS volume
FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
"""

# equal texts share a link; two sources are another feed, one has blank links
SEARCH_ITEMS = """
SELECT CAST(doc_id % 8 AS INT) AS query_pos, CAST(floor(doc_id / 4000) AS INT) AS page_start, doc_id AS item_id,
       CASE WHEN source IN ('src3', 'src7') THEN 'video' ELSE 'articles' END AS feedname,
       CASE WHEN source = 'src5' THEN ' ' ELSE concat(' https://news.example.com/', md5(text)) END AS link,
       split_part(text, '.', 1) AS title,
       CASE lang WHEN 'en' THEN concat('Sep ', CAST(1 + n_chars % 28 AS VARCHAR(2)), ', 2025')
                 WHEN 'fr' THEN concat('September 0', CAST(1 + n_chars % 9 AS VARCHAR(2)), ', 2024')
                 WHEN 'de' THEN 'soon' ELSE '' END AS pubdate
FROM documents
"""

# W and H rows of eight topics
FACTORS = """
SELECT vec_id, concat('v', CAST(vec_id AS VARCHAR(20))) AS term, label,
       {weights} AS weights
FROM embeddings
"""


def bind_tables(sql: str, sf_dir: str) -> str:
    """The SQL with table names replaced by their files."""
    names = "|".join(TABLES)
    return re.sub(rf"\b(FROM|JOIN)\s+({names})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(bind_tables(ARTICLES, sf_dir)))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(bind_tables(POSTS.replace('"', "`"), sf_dir)))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(bind_tables(PRICES, sf_dir)).withColumn("datetime", F.date_format("d", "yyyyMMdd"))


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(bind_tables(SEARCH_ITEMS, sf_dir)))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("term"), "label", weights.alias("weights")
    )


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketprose.operators.topics import topic_terms

    return topic_terms(factors(spark, sf_dir))


def price_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chart document per ticker and year, at most 366 bars each."""
    bars = F.array_sort(
        F.collect_list(
            F.struct(F.unix_timestamp(F.col("d").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume", "adjclose")
        )
    )
    column = lambda name: F.transform(F.col("b"), lambda x: x[name]).alias(name if name != "t" else "timestamp")
    grouped = prices(spark, sf_dir).groupBy("ticker", F.year("d").alias("y")).agg(bars.alias("b"))
    quote = F.struct(*[column(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(
        column("t"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(column("adjclose"))).alias("adjclose")).alias("indicators"),
    )
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return grouped.select("ticker", body.alias("body"))


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed result pages of at most 500 items, and the web pages as pages that hold no result."""
    items = F.array_sort(F.collect_list(F.struct("item_id", "feedname", "link", "title", "pubdate")))
    pages = search_items(spark, sf_dir).groupBy("query_pos", "page_start").agg(items.alias("items"))
    body = F.to_json(F.struct(F.struct(F.size("items").alias("total")).alias("metadata"), "items"))
    terms = F.array(*[F.lit(t) for t in SEARCH_TERMS])
    good = pages.select(
        F.get(terms, F.col("query_pos")).alias("query"),
        "query_pos",
        "page_start",
        F.concat(F.lit("searchPage.resultcallback("), body, F.lit(");")).alias("body"),
    )
    other = table(spark, sf_dir, "pages").select(
        F.lit("other").alias("query"),
        F.lit(len(SEARCH_TERMS)).alias("query_pos"),
        F.col("page_id").cast("int").alias("page_start"),
        F.col("html").alias("body"),
    )
    return good.union(other)


# every form an author may take, by source
AUTHOR_JSON = """
CASE source WHEN 'src0' THEN NULL
            WHEN 'src1' THEN '""'
            WHEN 'src2' THEN concat('{"@type":"Person","name":" ', source, ' "}')
            WHEN 'src3' THEN concat('["', source, '",{"name":"Staff"},{"name":" "},"",["', lang, '"]]')
            WHEN 'src4' THEN '{"@type":"Person"}'
            WHEN 'src5' THEN '"{braces} Jr [x]"'
            WHEN 'src6' THEN concat('[[[[["deep ', lang, '"]]]],5,true,null,{"name":["no"]},{"x":{"name":"no"},"name":"Z"}]')
            WHEN 'src7' THEN '7'
            ELSE concat('" ', source, '"') END
"""
AUTHOR_NAME = """
CASE source WHEN 'src0' THEN '' WHEN 'src1' THEN '' WHEN 'src4' THEN '' WHEN 'src7' THEN ''
            WHEN 'src5' THEN '{braces} Jr [x]' WHEN 'src6' THEN concat('deep ', lang, ', Z')
            WHEN 'src3' THEN concat(source, ', Staff, ', lang) ELSE source END
"""


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article pages (link, html) wrapping the documents, and the web pages, which hold no article.

    The block is alone, second after a broken one, or inside a list with other things after one that is commented out; French pages lack the headline,
    German ones the date, Spanish ones are no articles.
    """
    docs = table(spark, sf_dir, "documents")
    block = F.struct(
        F.when(F.col("lang") == "es", "WebPage").when(F.col("lang") == "de", "Article").otherwise("NewsArticle").alias("@type"),
        F.when(F.col("lang") != "fr", F.concat(F.lit(" "), F.split_part("text", F.lit("."), F.lit(1)))).alias("headline"),
        F.when(F.col("lang") != "de", F.col("n_chars").cast("string")).alias("datePublished"),
        F.col("text").alias("articleBody"),
    )
    body = F.replace(F.to_json(block), F.lit("</"), F.lit("<\\/"))
    author = F.expr(AUTHOR_JSON)
    body = F.when(author.isNotNull(), F.concat(F.lit('{"author":'), author, F.lit(","), F.substring(body, 2, 1 << 30))).otherwise(body)
    tag = F.lit('<script type="application/ld+json">')
    end = F.lit("</script>")
    other = F.lit('{"@type":"WebSite","headline":"site"}')
    hidden = F.lit('{"@type":"Article","headline":"hidden"}')
    commented = F.concat(F.lit("<!-- "), tag, hidden, end, F.lit(" --><script>var a = '<!-- ';</script>"))
    blocks = (
        F.when(F.col("n_chars") % 3 == 0, F.concat(tag, body, end))
        .when(F.col("n_chars") % 3 == 1, F.concat(tag, F.lit("{broken"), end, F.lit("<SCRIPT id='b' type='application/ld+json'>"), body, end))
        .otherwise(F.concat(commented, tag, F.lit('["x",7,[],'), other, F.lit(","), body, F.lit("]"), end))
    )
    link = F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string"))
    wrapped = docs.select(
        link.alias("link"), F.concat(F.lit("<html><head>"), blocks, F.lit("</head><body><p>x</p></body></html>")).alias("html")
    )
    return wrapped.union(table(spark, sf_dir, "pages").select(F.col("url").alias("link"), "html"))
