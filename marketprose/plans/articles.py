"""Articles to reports, topics, flags with sentiment, and daily splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marketprose.functions import words as W
from marketprose.functions.dates import coerce_date
from marketprose.operators import aggregates as A
from marketprose.operators.clean import add_word_count, keep_pos, preprocess_text
from marketprose.operators.keywords import cloud_weights, keyword_frequency
from marketprose.operators.lda import fit_lda
from marketprose.operators.select import filter_nonempty, filter_split, filter_year_text, rule_flag, split_label
from marketprose.operators.sentiment import add_sentiment
from marketprose.operators.stopwords import KEYWORDS
from marketprose.operators.tokens import tokenize_articles
from marketprose.operators.topics import doc_topic_wide, topic_distribution, topic_summary
from marketprose.session import written


@dataclass
class ArticleReport:
    cleaned: DataFrame  # articles with clean and word_count
    per_month: DataFrame  # year, month_no, month_name, n
    mean_words: DataFrame
    word_histogram: DataFrame
    keywords: Callable[[], DataFrame]  # word, freq; runs when called
    cloud: Callable[[], DataFrame]  # term, freq, weight; runs when called


def article_report(articles: DataFrame, doc: str, text: str = "content", stops: Sequence[str] = KEYWORDS) -> ArticleReport:
    """What the article notebook shows: counts per month, lengths, keywords, word weights."""
    cleaned, _ = preprocess_text(articles, text, min_tokens=0, use_pos=False)
    counted = add_word_count(cleaned, text)
    lengths = add_word_count(articles.select(text), text)
    return ArticleReport(
        counted,
        A.by_year_month(A.monthly_counts(articles)),
        A.mean_of(lengths),
        A.histogram(lengths, "word_count"),
        lambda: keyword_frequency(articles, text, doc, stops),
        lambda: cloud_weights(articles, text, doc, stops=stops),
    )


@dataclass
class ArticleTopics:
    summary: DataFrame  # topic, top_terms
    distribution: DataFrame  # doc, kept columns, topic_0.., dominant_topic, dominant_score
    counts: DataFrame  # dominant_topic, n


def article_topics(
    tokenized: DataFrame,
    doc: str,
    topics: int = 10,
    max_iter: int = 20,
    seed: int = 42,
    keep: Sequence[str] = ("link", "title", "date"),
    topn: int = 10,
    **limits,
) -> ArticleTopics:
    """Topics of the articles' noun texts; articles without nouns are left out."""
    nouns = written(filter_nonempty(tokenized, "clean_text_nouns").select(doc, *keep, "clean_text_nouns"), "article-nouns")
    fit = fit_lda(nouns, "clean_text_nouns", doc, topics, max_iter, seed, **limits)
    weights = fit.doc_topics.join(nouns.select(doc, *keep), doc)
    wide = doc_topic_wide(weights, topics, (doc, *keep))
    return ArticleTopics(topic_summary(fit.terms, topn), wide, topic_distribution(wide))


def article_signals(
    articles: DataFrame, text: str = "content", years: Sequence[int] = (2023, 2024, 2025), rules=W.CASE_RULES
) -> DataFrame:
    """Articles of the years with flag_case, compound_score and sentiment_label."""
    chosen = filter_year_text(articles, "date", years)
    return add_sentiment(chosen, text).withColumn("flag_case", rule_flag(F.col(text), rules))


def daily_splits(cleaned: DataFrame, doc: str, text: str = "clean_text", ranges=W.SPLIT_RANGES) -> DataFrame:
    """The text of each day in pieces (date, seq, text, split), of the kept parts of speech only.

    Days outside the ranges are dropped, and words are filtered per document, before anything is moved.
    """
    date = coerce_date(F.col("date")) if dict(cleaned.dtypes)["date"] == "string" else F.to_date("date")
    dated = cleaned.select(doc, date.alias("date"), text)
    wanted = filter_split(dated.withColumn("split", split_label(F.col("date"), ranges))).drop("split")
    # written, since the cut into ranges reads it twice
    kept = written(wanted.withColumn(text, keep_pos(F.col(text))), "kept-words")
    return A.daily_text(kept, "date", text, doc).withColumn("split", split_label(F.col("date"), ranges))


def tokenized_articles(articles: DataFrame, text: str = "content", columns: Sequence[str] = (), **options) -> DataFrame:
    """The token table that topics and splits start from, written once: all columns, or those that are read."""
    tokens = tokenize_articles(articles, text, **options)
    return written(tokens.select(*columns) if columns else tokens, "articles-tokens")
