"""Whole flows, from raw input to the tables a user keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketprose.functions import words as W
from marketprose.operators import stopwords as SW
from marketprose.plans import articles as PA
from marketprose.plans import ingest as PI
from marketprose.plans import posts as PP
from marketprose.plans import prices as PX
from marketprose.queries import inputs as I
from marketprose.queries import relational as R
from marketprose.queries import sqlparts as P
from marketprose.queries import text as QT
from marketprose.queries.registry import SQL, query


@query(
    "price_flags",
    R.prices_sql(R._LAGGED, f'SELECT ticker, datetime, day_order, "T_price", {R._LAG_NAMES}, {R._FLAGS} FROM lagged'),
)
def price_flags(spark, sf_dir):
    """From landed chart documents to flags."""
    flags = PX.price_flags(PI.ingest_prices(I.price_charts(spark, sf_dir)))
    names = [f"T_minus_{k}_price" for k in W.LAGS] + [f"change_vs_T_minus_{k}" for k in W.LAGS]
    return flags.select("ticker", "datetime", "day_order", "T_price", *names)


@query(
    "ingest_articles",
    f"""SELECT title, max(date) AS date FROM (SELECT {P.strip("CASE WHEN lang = 'fr' THEN split_part(text, '.', 1) ELSE split_part(text, '.', 1) END")} AS title,
    CASE WHEN lang = 'de' THEN CASE WHEN doc_id % 97 = 0 THEN 'not a date'
      ELSE CAST(DATE '2011-10-01' + CAST(((doc_id * 37) % 100) * 53 AS INT) AS VARCHAR) END ELSE CAST(n_chars AS VARCHAR) END AS date
    FROM documents WHERE lang <> 'es') GROUP BY title""",
)
def ingest_articles(spark, sf_dir):
    """From landed pages and the link table to articles, each title once with its latest date text."""
    links = I.articles(spark, sf_dir).select("link", F.trim("title").alias("title"), "date")
    return PI.ingest_articles(I.article_pages(spark, sf_dir), links).select("title", "date")


@query(
    "article_signals",
    f"""SELECT a.doc_id, r.flag_case, s.compound_score, s.sentiment_label FROM ({I.ARTICLES}) a
    JOIN ({SQL['rule_flag']}) r ON a.doc_id = r.doc_id JOIN ({SQL['sentiment_lexicon']}) s ON a.doc_id = s.doc_id
    WHERE regexp_matches(a.date, '2023|2024|2025')""",
)
def article_signals(spark, sf_dir):
    out = PA.article_signals(I.articles(spark, sf_dir))
    return out.select("doc_id", "flag_case", "compound_score", "sentiment_label")


@query(
    "daily_splits",
    f"""SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY doc_id) - 1 AS BIGINT) AS seq,
      {P.kept_words('clean_text')} AS clean_text, {P.split_case('date')} AS split
      FROM (SELECT a.doc_id, try_cast(date AS DATE) AS date, clean_text
        FROM ({I.ARTICLES}) a JOIN ({SQL['tokens_all']}) t ON a.doc_id = t.doc_id
        WHERE clean_text IS NOT NULL AND try_cast(date AS DATE) BETWEEN DATE '2011-12-01' AND DATE '2025-04-14')""",
)
def daily_splits(spark, sf_dir):
    """From articles to split daily texts."""
    read = ("doc_id", "date", "clean_text")
    tokens = PA.tokenized_articles(I.articles(spark, sf_dir), columns=read, phrases=QT.PHRASES, nouns=False)
    return PA.daily_splits(tokens, "doc_id")


@query("article_topics")
def article_topics(spark, sf_dir):
    """From articles to their dominant topics, on noun texts."""
    tokens = PA.tokenized_articles(I.articles(spark, sf_dir))
    return PA.article_topics(tokens, "doc_id").distribution


@query("post_topics")
def post_topics(spark, sf_dir):
    """From raw posts to topic ids."""
    return PP.post_topics(I.posts(spark, sf_dir), "post_id").posts.select("post_id", "topic_id", "topic_score")


def _report(spark, sf_dir):
    return PA.article_report(I.articles(spark, sf_dir), "doc_id")


def _on_articles(sql: str) -> str:
    """The same SQL over the contents of the articles."""
    return sql.replace("FROM documents", f"FROM (SELECT doc_id, content AS text FROM ({I.ARTICLES}))")


@query("article_report_months", SQL["articles_by_year_month"])
def article_report_months(spark, sf_dir):
    return _report(spark, sf_dir).per_month


@query("article_report_mean", SQL["mean_word_count"])
def article_report_mean(spark, sf_dir):
    return _report(spark, sf_dir).mean_words.select(F.round("mean", 6).alias("mean"))


@query("article_report_histogram", SQL["wordcount_histogram"])
def article_report_histogram(spark, sf_dir):
    bins = _report(spark, sf_dir).word_histogram
    return bins.select("bin", F.round("bin_low", 6).alias("bin_low"), F.round("bin_high", 6).alias("bin_high"), "freq")


@query(
    "article_report_cleaned",
    P.with_articles(
        f"""SELECT doc_id, {P.clean(P.to_text('content'), SW.CLEANING, False)} AS clean,
        CAST(len({P.runs(P.to_text('content'))}) AS BIGINT) AS word_count FROM articles"""
    ),
)
def article_report_cleaned(spark, sf_dir):
    return _report(spark, sf_dir).cleaned.select("doc_id", "clean", "word_count")


@query("article_report_keywords", _on_articles(SQL["keyword_frequency"]))
def article_report_keywords(spark, sf_dir):
    return _report(spark, sf_dir).keywords()


@query("article_report_cloud", _on_articles(SQL["wordcloud_weights"]))
def article_report_cloud(spark, sf_dir):
    return _report(spark, sf_dir).cloud().withColumn("weight", F.round("weight", 6))
