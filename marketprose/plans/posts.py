"""Social posts to topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marketprose.operators.clean import preprocess_text
from marketprose.operators.nmf import fit_nmf
from marketprose.operators.select import drop_null_text
from marketprose.operators.topics import attach_topic, topic_distribution, topic_terms, topics_table
from marketprose.operators.vectorize import tfidf
from marketprose.session import written


def clean_posts(
    raw: DataFrame,
    key: str,
    candidates: Sequence[str] = ("fullText", "text"),
    min_tokens: int = 3,
    use_pos: bool = True,
    drop_null: bool = False,
    **options,
) -> DataFrame:
    """(key, text, clean) of the posts with enough tokens."""
    cleaned, column = preprocess_text(raw, None, candidates, min_tokens, use_pos, **options)
    out = cleaned.select(key, F.col(column).alias("text"), "clean")
    return drop_null_text(out, "text") if drop_null else out


@dataclass
class PostTopics:
    posts: DataFrame  # key, text, clean, topic_id, topic_score
    terms: DataFrame  # topic, term, weight, rank
    counts: DataFrame  # topic_id, n
    iterations: int


def post_topics(
    raw: DataFrame,
    key: str,
    topics: int = 8,
    ngram_range: tuple[int, int] = (1, 3),
    min_df: int | float = 10,
    max_df: int | float = 0.85,
    max_iter: int = 400,
    seed: int = 42,
    topn: int = 12,
    init: str = "nndsvd",
    **cleaning,
) -> PostTopics:
    """Clean, weight, factor, and give every post its strongest topic.

    The cleaned posts are written once; counting, weighting and the result read that table.
    """
    clean = written(clean_posts(raw, key, **cleaning), "posts-clean")
    cells, vocab = tfidf(clean, "clean", key, ngram_range, min_df, max_df)
    fit = fit_nmf(cells, key, topics=topics, max_iter=max_iter, seed=seed, init=init, vocab=vocab)
    assigned = attach_topic(clean, fit.doc_factors, key, topics)
    terms = topics_table(topic_terms(fit.term_factors), topn)
    return PostTopics(assigned, terms, topic_distribution(assigned, "topic_id"), fit.iterations)
