"""Projections, filters, joins, windows, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketprose.functions import words as W
from marketprose.functions.dates import coerce_date
from marketprose.functions.text import split_tokens, to_text
from marketprose.operators import aggregates as A
from marketprose.operators import clean as C
from marketprose.operators import lookups as J
from marketprose.operators import ordering as O
from marketprose.operators import patterns as PT
from marketprose.operators import select as S
from marketprose.operators import windows as N
from marketprose.operators.stopwords import CLEANING
from marketprose.queries import inputs as I
from marketprose.queries import sqlparts as P
from marketprose.queries.registry import query
from marketprose.sources.tables import union_tables

# ---- projections and filters -------------------------------------------------


@query("detect_text_column", P.with_posts('SELECT post_id, "fullText" AS text FROM posts'))
def detect_text_column(spark, sf_dir):
    posts = I.posts(spark, sf_dir)
    return posts.select("post_id", F.col(S.detect_text_column(posts, ("fullText", "text"))).alias("text"))


@query("project_rename", P.with_posts('SELECT post_id AS id, "fullText" AS text FROM posts'))
def project_rename(spark, sf_dir):
    return S.project(I.posts(spark, sf_dir), {"post_id": "id", "fullText": "text"})


@query("to_text", P.with_articles(f"SELECT doc_id, {P.to_text('content')} AS out FROM articles"))
def to_text_query(spark, sf_dir):
    return I.articles(spark, sf_dir).select("doc_id", to_text(F.col("content")).alias("out"))


@query("drop_null_text", P.with_articles("SELECT doc_id, content FROM articles WHERE content IS NOT NULL"))
def drop_null_text(spark, sf_dir):
    return S.drop_null_text(I.articles(spark, sf_dir).select("doc_id", "content"), "content")


@query("filter_ticker", P.with_prices("SELECT ticker, datetime, close FROM prices WHERE ticker = '1-URGENT'"))
def filter_ticker(spark, sf_dir):
    return S.filter_ticker(I.prices(spark, sf_dir), "1-URGENT").select("ticker", "datetime", "close")


@query(
    "filter_feed",
    P.with_items("SELECT item_id, trim(link) AS link FROM search_items WHERE feedname = 'articles' AND trim(link) <> ''"),
)
def filter_feed(spark, sf_dir):
    return S.filter_feed(I.search_items(spark, sf_dir)).select("item_id", "link")


@query(
    "filter_min_tokens",
    P.with_articles(f"SELECT doc_id, content FROM articles WHERE len({P.split('content')}) >= 100"),
)
def filter_min_tokens(spark, sf_dir):
    return S.filter_min_tokens(I.articles(spark, sf_dir), "content", 100).select("doc_id", "content")


@query(
    "filter_nonempty",
    f"SELECT doc_id, clean FROM (SELECT doc_id, {P.clean('text', CLEANING, True)} AS clean FROM documents) WHERE clean <> ''",
)
def filter_nonempty(spark, sf_dir):
    docs = S.once(I.table(spark, sf_dir, "documents"), "clean", C.clean_nouns(F.col("text")))
    return S.filter_nonempty(docs, "clean").select("doc_id", "clean")


@query(
    "filter_year_regex",
    P.with_articles("SELECT doc_id, date FROM articles WHERE regexp_matches(date, '2023|2024|2025')"),
)
def filter_year_regex(spark, sf_dir):
    return S.filter_year_text(I.articles(spark, sf_dir)).select("doc_id", "date")


@query(
    "filter_year_typed",
    "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1994, 1996)",
)
def filter_year_typed(spark, sf_dir):
    return S.filter_year(I.table(spark, sf_dir, "orders"), "o_orderdate", (1994, 1996)).select("o_orderkey")


_sql_split = P.split_case


def _labelled(spark, sf_dir):
    return I.articles(spark, sf_dir).select("doc_id", S.split_label(coerce_date(F.col("date"))).alias("split"))


@query("time_split", P.with_articles(f"SELECT doc_id, {_sql_split('try_cast(date AS DATE)')} AS split FROM articles"))
def time_split(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(
    "filter_split",
    P.with_articles(
        f"SELECT * FROM (SELECT doc_id, {_sql_split('try_cast(date AS DATE)')} AS split FROM articles) WHERE split <> 'exclude'"
    ),
)
def filter_split(spark, sf_dir):
    return S.filter_split(_labelled(spark, sf_dir))


@query(
    "rule_flag",
    P.with_articles(
        rf"""SELECT doc_id, CASE WHEN lower(content) LIKE '%tesla%' OR lower(content) LIKE '%electric car%' OR lower(content) LIKE '%ev%'
        THEN 'Tesla/Electric Car' WHEN lower(content) LIKE '%spacex%' OR lower(content) LIKE '%nasa%' OR lower(content) LIKE '%rocket%'
        OR lower(content) LIKE '%astronaut%' THEN 'SpaceX/NASA' END AS flag_case,
        CASE WHEN regexp_matches(lower(content), '(^|[^{P.WD}])(tesla|electric car|ev)($|[^{P.WD}])') THEN 'Tesla/Electric Car'
        WHEN regexp_matches(lower(content), '(^|[^{P.WD}])(spacex|nasa|rocket|astronaut)($|[^{P.WD}])') THEN 'SpaceX/NASA' END AS flag_word
        FROM articles"""
    ),
)
def rule_flag(spark, sf_dir):
    text = F.col("content")
    return I.articles(spark, sf_dir).select(
        "doc_id", S.rule_flag(text).alias("flag_case"), S.rule_flag(text, match="word").alias("flag_word")
    )


@query(
    "rule_flag_table",
    f"""WITH articles AS ({I.ARTICLES}),
    hits AS (SELECT doc_id, min(item_id) AS item_id FROM articles JOIN benchmark b ON contains(lower(content), lower(b.text)) GROUP BY doc_id)
    SELECT a.doc_id, 'item ' || CAST(h.item_id AS VARCHAR) AS flag_case FROM articles a LEFT JOIN hits h ON a.doc_id = h.doc_id""",
)
def rule_flag_table(spark, sf_dir):
    """Rules kept as a table: each benchmark text is a keyword, its item the label."""
    items = I.table(spark, sf_dir, "benchmark")
    rules = items.select(
        F.col("item_id").alias("rule_pos"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"), F.col("text").alias("keyword")
    )
    return PT.rule_flag_table(I.articles(spark, sf_dir), "doc_id", "content", rules)


@query(
    "stamp_literals",
    P.with_prices("SELECT d, close, ticker, 'daily_price' AS table_name FROM prices"),
)
def stamp_literals(spark, sf_dir):
    return S.stamp(I.prices(spark, sf_dir).select("d", "close", "ticker"), table_name="daily_price")


# ---- windows -----------------------------------------------------------------

_W = "PARTITION BY ticker ORDER BY datetime"
_ORDERED = f"ordered AS (SELECT *, CAST(row_number() OVER ({_W}) AS BIGINT) AS day_order FROM prices)"
_LAGS = ", ".join(f"lag(close, {k}) OVER ({_W}) AS \"T_minus_{k}_price\"" for k in W.LAGS)
_LAGGED = f"{_ORDERED}, lagged AS (SELECT *, {_LAGS}, adjclose AS \"T_price\" FROM ordered)"
_LAG_NAMES = ", ".join(f'"T_minus_{k}_price"' for k in W.LAGS)
_FLAGS = ", ".join(
    f'CASE WHEN "T_price" > "T_minus_{k}_price" THEN 1 ELSE 0 END AS "change_vs_T_minus_{k}"' for k in W.LAGS
)


def prices_sql(ctes: str, rest: str) -> str:
    return f"WITH prices AS (SELECT *, strftime(d, '%Y%m%d') AS datetime FROM ({I.PRICES})), {ctes} {rest}"


def _ordered(spark, sf_dir):
    return N.day_order(I.prices(spark, sf_dir))


def _lagged(spark, sf_dir):
    # small blocks, so that the test data crosses many block borders
    return N.lag_prices(_ordered(spark, sf_dir), block=256)


@query("day_order", prices_sql(_ORDERED, "SELECT ticker, datetime, day_order FROM ordered"))
def day_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select("ticker", "datetime", "day_order")


@query("lag_prices", prices_sql(_LAGGED, f'SELECT ticker, datetime, "T_price", {_LAG_NAMES} FROM lagged'))
def lag_prices(spark, sf_dir):
    return _lagged(spark, sf_dir).select("ticker", "datetime", "T_price", *[f"T_minus_{k}_price" for k in W.LAGS])


@query("change_flags", prices_sql(_LAGGED, f"SELECT ticker, datetime, {_FLAGS} FROM lagged"))
def change_flags(spark, sf_dir):
    flagged = N.change_flags(_lagged(spark, sf_dir))
    return flagged.select("ticker", "datetime", *[f"change_vs_T_minus_{k}" for k in W.LAGS])


@query(
    "first_per_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def first_per_key(spark, sf_dir):
    return N.first_per_key(I.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


@query(
    "topn_per_group",
    """SELECT event_type, event_id, value, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 12""",
)
def topn_per_group(spark, sf_dir):
    top = N.top_per_group(I.table(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.col("event_id")], 12)
    return top.select("event_type", "event_id", "value", "rank")


# ---- sorts, limits, duplicates -----------------------------------------------


@query(
    "dedup_links",
    P.with_items(
        """SELECT link, item_id, query_pos FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY query_pos, page_start, item_id) AS rn
        FROM search_items) WHERE rn = 1"""
    ),
)
def dedup_links(spark, sf_dir):
    items = I.search_items(spark, sf_dir).withColumn("item_pos", F.col("item_id"))
    return O.dedup_links(items).select("link", "item_id", "query_pos")


@query(
    "dedup_titles",
    P.with_articles(
        """SELECT title, link, date FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY date DESC, link) AS rn FROM articles)
        WHERE rn = 1"""
    ),
)
def dedup_titles(spark, sf_dir):
    return O.dedup_titles(I.articles(spark, sf_dir)).select("title", "link", "date")


@query("sort_date_desc", P.with_articles("SELECT link, date FROM articles ORDER BY try_cast(date AS DATE) DESC NULLS LAST, link"))
def sort_date_desc(spark, sf_dir):
    return O.sort_date_desc(I.articles(spark, sf_dir).select("link", "date"))


@query("sort_chronological", P.with_prices("SELECT ticker, datetime, close FROM prices ORDER BY datetime, ticker"))
def sort_chronological(spark, sf_dir):
    return O.sort_chronological(I.prices(spark, sf_dir).select("ticker", "datetime", "close"))


@query(
    "head_tail",
    P.with_prices(
        """(SELECT 'last' AS side, ticker, datetime, close FROM prices ORDER BY datetime DESC, ticker LIMIT 10)
        UNION ALL (SELECT 'first', ticker, datetime, close FROM prices ORDER BY datetime, ticker LIMIT 5)"""
    ),
)
def head_tail(spark, sf_dir):
    prices = I.prices(spark, sf_dir).select("ticker", "datetime", "close")
    last = O.head(prices, [F.desc("datetime"), F.col("ticker")], 10).withColumn("side", F.lit("last"))
    return last.unionByName(O.head(prices, ["datetime", "ticker"], 5).withColumn("side", F.lit("first")))


@query(
    "scan_limit",
    P.with_items("SELECT item_id, link FROM (SELECT * FROM search_items ORDER BY item_id LIMIT 100) WHERE trim(link) <> ''"),
)
def scan_limit(spark, sf_dir):
    items = I.search_items(spark, sf_dir).withColumn("l", F.trim("link"))
    return O.scan_limit(items, "item_id", 100, column="l").select("item_id", "link")


# ---- set operations ----------------------------------------------------------


@query(
    "union_tickers",
    P.with_prices(
        "SELECT ticker, datetime, close, CAST(NULL AS DOUBLE) AS high FROM prices "
        "UNION ALL SELECT ticker, datetime, NULL, high FROM prices"
    ),
)
def union_tickers(spark, sf_dir):
    """Frames with different columns, stacked by name."""
    prices = I.prices(spark, sf_dir)
    return union_tables(prices.select("ticker", "datetime", "close"), prices.select("high", "datetime", "ticker"))


# ---- aggregates --------------------------------------------------------------

_MONTHLY = f"""WITH articles AS ({I.ARTICLES}),
m AS (SELECT CAST(date_trunc('month', try_cast(date AS DATE)) AS DATE) AS month FROM articles WHERE try_cast(date AS DATE) IS NOT NULL),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month),
monthly AS (SELECT s.month, CAST(count(m.month) AS BIGINT) AS n FROM spine s LEFT JOIN m ON s.month = m.month GROUP BY s.month)"""


@query("monthly_article_counts", f"{_MONTHLY} SELECT month, n FROM monthly")
def monthly_article_counts(spark, sf_dir):
    return A.monthly_counts(I.articles(spark, sf_dir))


@query(
    "articles_by_year_month",
    f"""{_MONTHLY} SELECT CAST(year(month) AS INT) AS year, CAST(month(month) AS INT) AS month_no,
    strftime(month, '%b') AS month_name, n FROM monthly""",
)
def articles_by_year_month(spark, sf_dir):
    return A.by_year_month(A.monthly_counts(I.articles(spark, sf_dir)))


@query(
    "year_month_grid",
    f"""{_MONTHLY} SELECT CAST(year(month) AS INT) AS year, {', '.join(
        f"CAST(sum(n) FILTER (month(month) = {i + 1}) AS BIGINT) AS {m}"
        for i, m in enumerate(('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec')))}
    FROM monthly GROUP BY 1""",
)
def year_month_grid(spark, sf_dir):
    return A.year_month_grid(A.monthly_counts(I.articles(spark, sf_dir)))


@query(
    "calendar_spine_join",
    """WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders
      WHERE o_totalprice > 300000 GROUP BY 1),
    spine AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM c), (SELECT max(month) FROM c), INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT s.month, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM spine s LEFT JOIN c ON s.month = c.month""",
)
def calendar_spine_join(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    counts = orders.groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("month")).agg(F.count("*").alias("n"))
    return A.calendar_spine(counts)


@query(
    "value_counts",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, event_type",
)
def value_counts(spark, sf_dir):
    return A.value_counts(I.table(spark, sf_dir, "events"), "event_type")


@query(
    "mean_word_count",
    P.with_articles(f"SELECT round(avg(len({P.runs(P.to_text('content'))})), 6) AS mean FROM articles"),
)
def mean_word_count(spark, sf_dir):
    counted = C.add_word_count(I.articles(spark, sf_dir), "content")
    return A.mean_of(counted).select(F.round("mean", 6).alias("mean"))


@query(
    "daily_text_concat",
    P.with_articles(
        """SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY doc_id) - 1 AS BIGINT) AS seq, content
        FROM (SELECT doc_id, try_cast(date AS DATE) AS date, content FROM articles)
        WHERE date IS NOT NULL AND content IS NOT NULL"""
    ),
)
def daily_text_concat(spark, sf_dir):
    dated = I.articles(spark, sf_dir).withColumn("date", coerce_date(F.col("date")))
    return A.daily_text(dated, text="content")


@query(
    "wordcount_histogram",
    P.with_articles(
        rf""", c AS (SELECT CAST(len({P.runs(P.to_text('content'))}) AS DOUBLE) AS x FROM articles),
        r AS (SELECT min(x) AS lo, max(x) AS hi FROM c),
        b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)) + 1, 50) AS BIGINT) AS bin, count(*) AS freq FROM c, r GROUP BY 1)
        SELECT g.bin, round(lo + (hi - lo) / 50 * (g.bin - 1), 6) AS bin_low, round(lo + (hi - lo) / 50 * g.bin, 6) AS bin_high,
          CAST(coalesce(freq, 0) AS BIGINT) AS freq
        FROM (SELECT CAST(unnest(generate_series(1, 50)) AS BIGINT) AS bin) g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin"""
    ).replace(")\n, c", "), c"),
)
def wordcount_histogram(spark, sf_dir):
    counted = C.add_word_count(I.articles(spark, sf_dir), "content")
    bins = A.histogram(counted, "word_count")
    return bins.select("bin", F.round("bin_low", 6).alias("bin_low"), F.round("bin_high", 6).alias("bin_high"), "freq")


@query("row_count", P.with_posts("SELECT CAST(count(*) AS BIGINT) AS n FROM posts"))
def row_count(spark, sf_dir):
    return A.row_count(I.posts(spark, sf_dir))


@query("distinct_days", P.with_articles("SELECT CAST(count(DISTINCT try_cast(date AS DATE)) AS BIGINT) AS n FROM articles"))
def distinct_days(spark, sf_dir):
    return A.distinct_count(I.articles(spark, sf_dir).withColumn("date", coerce_date(F.col("date"))), "date")


@query(
    "doc_frequency",
    P.with_posts(
        f"""SELECT term, CAST(count(DISTINCT post_id) AS BIGINT) AS df FROM (SELECT post_id, unnest({P.split(P.cleanup('"fullText"'))}) AS term FROM posts)
        GROUP BY term HAVING count(DISTINCT post_id) >= 10 AND count(DISTINCT post_id) <= 0.85 * (SELECT count(*) FROM posts)"""
    ),
)
def doc_frequency(spark, sf_dir):
    from marketprose.functions.text import basic_cleanup

    posts = I.posts(spark, sf_dir)
    frequency = A.documents_per_term(posts, split_tokens(basic_cleanup(F.col("fullText"))))
    return A.frequency_cut(frequency, posts.agg(F.count("*")).scalar(), 10, 0.85)


@query(
    "term_counts",
    P.with_posts(
        f"""SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest({P.split('"fullText"')}) AS word FROM posts) GROUP BY word"""
    ),
)
def term_counts(spark, sf_dir):
    return A.term_counts(I.posts(spark, sf_dir), split_tokens(F.col("fullText")))


@query(
    "row_max_argmax",
    """SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS best, round(list_max(e), 6) AS score
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""",
)
def row_max_argmax(spark, sf_dir):
    weights = F.col("embedding").cast("array<double>")
    return I.table(spark, sf_dir, "embeddings").select(
        "vec_id", A.row_argmax(weights).alias("best"), F.round(A.row_max(weights), 6).alias("score")
    )
