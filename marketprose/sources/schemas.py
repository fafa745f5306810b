"""Explicit schemas of the tables and of the raw documents."""

from __future__ import annotations

PRICES = (
    "timestamp timestamp, open double, high double, low double, close double, adjclose double, volume bigint, "
    "datetime string, year int, month int, day int, ticker string, table_name string"
)
LINKS = "title string, date string, link string, query string"
ARTICLES = "title string, date string, link string, author string, content string"
ARTICLES_CLEANED = f"{ARTICLES}, tokens string, tokens_with_ngrams string, clean_text string"
POSTS = "fullText string, createdAt string"
POSTS_CLEAN = "text string, clean string"
POSTS_TOPICS = "text string, clean string, topic_id int, topic_score double"
TOPIC_TERMS = "topic int, term string, weight double"
TOPIC_SUMMARY = "topic int, top_terms string"
SPLITS = "date date, seq bigint, clean_text string, split string"

CHART = """
struct<chart: struct<result: array<struct<
  timestamp: array<bigint>,
  indicators: struct<
    quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>,
    adjclose: array<struct<adjclose: array<double>>>>>>>>
"""
SEARCH_PAGE = """
struct<metadata: struct<total: bigint>,
  items: array<struct<feedname: string, link: string, title: string, pubdate: string>>>
"""
