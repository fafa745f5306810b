"""Stop-word sets as small tuples for plans, or as tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from marketprose.functions import words as W


def stop_set(extra: Iterable[str] = (), base: Iterable[str] = W.ENGLISH_STOPS) -> tuple[str, ...]:
    """Base and extra words, sorted, each once."""
    return tuple(sorted({*base, *extra}))


CLEANING = stop_set(W.CLEANING_STOPS)
KEYWORDS = stop_set(W.KEYWORD_STOPS)


def protected_words(phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES) -> tuple[str, ...]:
    """Every phrase, and every word in one."""
    return tuple(sorted({w for phrase, _ in phrases for w in (phrase, *phrase.split())}))


def token_stops(phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES, base: Iterable[str] = W.ENGLISH_STOPS):
    """Stop words of the token stage, with protected words taken out."""
    keep = set(protected_words(phrases))
    return tuple(w for w in stop_set((*W.TOKEN_STOPS, *W.CLITIC_STOPS), base) if w not in keep)


def build_stopwords(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Union of word tables (column ``word``), each word once."""
    out = base.select("word")
    for table in more:
        out = out.union(table.select("word"))
    return out.distinct()


def protect_stopwords(stops: DataFrame, protected: DataFrame) -> DataFrame:
    """The stop table without the protected phrases (column ``phrase``) and their parts."""
    parts = protected.select(F.explode(F.concat(F.array("phrase"), F.split("phrase", " "))).alias("word"))
    return stops.select("word").distinct().join(parts.distinct(), "word", "left_anti")
