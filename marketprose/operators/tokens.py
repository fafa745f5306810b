"""Tokens of articles: protected phrases, lemmas, noun tokens, n-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.functions import words as W
from marketprose.operators.lexicon import Found, look_up
from marketprose.operators.select import once
from marketprose.operators.stopwords import protected_words, token_stops

# Alternatives in order: web address, mail address, bare domain, number with separators,
# dotted abbreviation, word, sentence end.
URL_TOKEN = rf"(?:https?://|www\.)[^{X.SPACE}]*[^{X.SPACE}.,!?;:)\"']"
EMAIL_TOKEN = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DOMAIN_TOKEN = r"(?:[A-Za-z0-9-]+\.)+(?:com|org|net|gov|edu|io)\b"
NUMBER_TOKEN = r"\p{N}+(?:[.,]\p{N}+)+"
ABBREVIATION_TOKEN = r"(?:\p{L}\.){2,}"
WORD_TOKEN = f"[{X.WORD}]+"
SENTENCE_END = "[.!?]+"
TOKEN_PATTERN = "|".join(
    (URL_TOKEN, EMAIL_TOKEN, DOMAIN_TOKEN, NUMBER_TOKEN, ABBREVIATION_TOKEN, WORD_TOKEN, SENTENCE_END)
)
WEB_TOKEN = f"^(?:{URL_TOKEN}|{EMAIL_TOKEN}|{DOMAIN_TOKEN})\\z"
CLITICS = r"(?i)n['’]t\b|['’](?:s|re|ve|ll|d|m)\b"


def protect_phrases(text: Column, phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES) -> Column:
    """Replace each phrase, in any case and spacing, by its one-word form."""
    gap = f"[{X.SPACE}]+"

    def step(low: Column, phrase: str, token: str, now: Column) -> Column:
        parts = phrase.split()
        pattern = rf"(?i)(?<![{X.WORD}]){gap.join(re.escape(p) for p in parts)}(?![{X.WORD}])"
        # most texts lack the phrase; a plain search is far cheaper than the pattern
        return F.when(low.contains(parts[0].lower()), F.regexp_replace(now, pattern, token)).otherwise(now)

    def replaced(low: Column) -> Column:
        out = text
        for phrase, token in phrases:
            out = X.bind(out, partial(step, low, phrase, token))
        return out

    return X.bind(F.lower(text), replaced)


def plain_text(text: Column, phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES) -> Column:
    """Text with single spaces, one-word phrases and without clitics."""
    clean = X.bind(X.collapse_whitespace(text), lambda t: protect_phrases(t, phrases))
    return X.bind(
        clean,
        lambda t: F.when(t.contains("'") | t.contains("’"), F.regexp_replace(t, CLITICS, " ")).otherwise(t),
    )


def raw_tokens(plain: Column) -> Column:
    # most words are ASCII, and before none of these marks a word can start nothing else
    word = rf"(?>[A-Za-z0-9_]++(?:[{X.WORD}]++)?|[{X.WORD}]++)(?![.,@+:\-])"
    return F.regexp_extract_all(plain, F.lit(rf"(?! )(?:{word}|{TOKEN_PATTERN})"), F.lit(0))


def pos_tags(
    raw: Column, low: Column, phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES, said: Found | None = None
) -> Column:
    """Part of speech of each token; ``low`` holds the tokens in lower case.

    It is PROTECTED for protected phrases, WEB for addresses, END for sentence ends, PROPN for
    a capitalized word inside a sentence, else what the lexicon says: the seed lists, or what was
    found (``said``) in a table for the lower-case tokens.
    """
    single = [token for _, token in phrases]
    # the marks sort before the letters
    ends = lambda w: (w < "@") & F.left(w, F.lit(1)).isin(".", "!", "?") & w.rlike(f"^{SENTENCE_END}\\z")

    def one(lower: Column, i: Column) -> Column:
        word = F.get(raw, i)
        inside = (i > 0) & ~ends(F.get(raw, i - 1))
        return (
            F.when(lower.isin(single), F.lit("PROTECTED"))
            .when(ends(word), F.lit("END"))
            .when((word.contains(".") | word.startswith("http")) & word.rlike(WEB_TOKEN), F.lit("WEB"))
            .when(~X.starts_plain(word) & word.rlike(r"^\p{Lu}") & inside, F.lit("PROPN"))
            .otherwise(said.pos(lower, i) if said else L.pos_tag(lower))
        )

    return F.transform(low, one)


def token_lemmas(low: Column, pos: Column, said: Found | None = None) -> Column:
    def one(lower: Column, i: Column) -> Column:
        return said.lemma(lower, F.get(pos, i), i) if said else L.token_lemma(lower, F.get(pos, i))

    return F.transform(low, one)


def _keep(norm: Column, pos: Column, stops: Sequence[str]) -> Column:
    worded = X.starts_plain(norm) | (~X.is_numeric(norm) & X.has_ascii_word_char(norm))
    content = ~norm.isin(list(stops)) & worded
    return (pos == "PROTECTED") | ((pos != "END") & content)


def kept_tokens(norms: Column, pos: Column, stops: Sequence[str] | None = None) -> Column:
    """Lemmas of the tagged tokens, less stop words, numbers and tokens without a-z, 0-9 or _."""
    stops = token_stops() if stops is None else stops
    return F.filter(norms, lambda norm, i: _keep(norm, F.get(pos, i), stops))


def kept_nouns(norms: Column, pos: Column, stops: Sequence[str] | None = None) -> Column:
    """The same for nouns, proper nouns and protected phrases only."""
    stops = token_stops() if stops is None else stops
    noun = lambda tag: tag.isin("PROTECTED", "PROPN", "NOUN")
    return F.filter(norms, lambda norm, i: noun(F.get(pos, i)) & _keep(norm, F.get(pos, i), stops))


def with_ngrams(tokens: Column, bigrams: bool = True, trigrams: bool = True, chained: bool = False) -> Column:
    """Tokens, then their bigrams, then their trigrams.

    ``chained`` builds the trigrams over tokens and bigrams together instead of over the tokens.
    """

    def build(t: Column) -> Column:
        two = F.concat(t, X.ngrams(t, 2)) if bigrams else t
        if not trigrams:
            return two
        return X.bind(two, lambda s: F.concat(s, X.ngrams(s if chained else t, 3)))

    return X.bind(tokens, build)


def tokenize_articles(
    articles: DataFrame,
    text: str = "content",
    phrases: Sequence[tuple[str, str]] = W.PROTECTED_PHRASES,
    stops: Sequence[str] | None = None,
    chained: bool = False,
    nouns: bool = True,
    words: bool = True,
    lexicon: DataFrame | None = None,
    key: str = "doc_id",
    keep: Sequence[str] | None = None,
    **join,
) -> DataFrame:
    """Add with ``words`` tokens, tokens_with_ngrams and clean_text, and with ``nouns`` the noun columns.

    Every column comes from one tagging of the text. ``lexicon`` is a table of any size (``operators.lexicon``) in
    place of the seed lists; it needs a unique ``key``. ``keep`` names the articles' columns that are wanted beside the new
    ones, all without; with a lexicon the others are neither stored nor moved.
    """
    stops = token_stops(phrases) if stops is None else stops
    # in steps: each is evaluated once per row, and shallow expressions run faster than one deep one
    plain = once(articles, "_plain", plain_text(F.coalesce(F.col(text), F.lit("")), phrases))
    raw = once(plain, "_raw", raw_tokens(F.col("_plain"))).drop("_plain")
    raw = raw if keep is None else raw.select(*keep, "_raw")
    said = None
    if lexicon is not None:
        raw = look_up(raw, key, F.transform("_raw", F.lower), lexicon, only=("pos", "noun", "verb"), cheap=True, **join)
        said = Found(lexicon)
    # flat arrays: an array of structs is copied whole at every step
    tagged = once(raw, "_low", F.transform("_raw", F.lower))
    tagged = once(tagged, "_pos", pos_tags(F.col("_raw"), F.col("_low"), phrases, said)).drop("_raw")
    tagged = once(tagged, "_norms", token_lemmas(F.col("_low"), F.col("_pos"), said)).drop("_low", "_found")
    out = tagged
    if words:
        out = once(out, "tokens", kept_tokens(F.col("_norms"), F.col("_pos"), stops))
    if nouns:
        out = once(out, "tokens_nouns", kept_nouns(F.col("_norms"), F.col("_pos"), stops))
        out = out.withColumn("clean_text_nouns", X.join_tokens(F.col("tokens_nouns")))
    out = out.drop("_norms", "_pos")
    if not words:
        return out
    grams = with_ngrams(F.col("tokens"), chained=chained)
    return out.withColumns({"tokens_with_ngrams": grams, "clean_text": X.join_tokens(F.col("tokens"))})
