"""Text cleaning: stop words out, codes in capitals, the rest lemmatized."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.functions import words as W
from marketprose.operators import lookups as J
from marketprose.operators import select as S
from marketprose.operators.lexicon import Found, look_up
from marketprose.operators.select import once
from marketprose.operators.stopwords import CLEANING


def _kept(word: Column, stops: Sequence[str]) -> Column:
    return ~word.isin(list(stops)) & ~X.is_short(word)


def _shaped(word: Column) -> Column:
    return F.when(X.is_code(word), F.upper(word)).otherwise(L.noun_lemma(word))


def clean_simple(text: Column, stops: Sequence[str] = CLEANING) -> Column:
    """Cleaned text without stop words and words of one or two characters."""
    tokens = F.filter(X.cleanup_tokens(text), lambda w: _kept(w, stops))
    return X.join_tokens(F.transform(tokens, _shaped))


def clean_nouns(text: Column, stops: Sequence[str] = CLEANING) -> Column:
    """As ``clean_simple``, keeping only nouns, cashtags and numbers."""
    tokens = F.filter(
        X.cleanup_tokens(text),
        lambda w: _kept(w, stops) & (X.is_code(w) | L.pos_tag(w).isin("NOUN", "PROPN")),
    )
    return X.join_tokens(F.transform(tokens, _shaped))


def clean_nouns_tagged(
    df: DataFrame, text: Column, tagger: Callable, stops: Sequence[str] = CLEANING, out: str = "clean"
) -> DataFrame:
    """``clean_nouns`` with the caller's tagger, a vectorized UDF from tokens to tags (``NN...`` is a noun)."""
    tokens = once(df, "_tokens", X.split_tokens(X.basic_cleanup(text)))
    tagged = once(tokens, "_tags", tagger(F.col("_tokens")))
    kept = F.filter(
        "_tokens",
        lambda w, i: _kept(w, stops) & (X.is_code(w) | F.get("_tags", i).startswith("NN")),
    )
    return tagged.withColumn(out, X.join_tokens(F.transform(kept, _shaped))).drop("_tokens", "_tags")


def clean_by_tables(
    df: DataFrame,
    doc: str,
    text: str,
    stops: DataFrame,
    lemmas: DataFrame,
    pos: DataFrame | None = None,
    out: str = "clean",
    **join,
) -> DataFrame:
    """(doc, clean) with word tables of any size: stops (word), lemmas (word, lemma), pos (word, pos).

    With ``pos``, words tagged ``NN...`` stay, besides cashtags and numbers. Texts move once, by
    document; while the tables are small enough to broadcast, that is the only shuffle of the tokens.
    """
    tokens = J.explode_tokens(df, X.split_tokens(X.basic_cleanup(X.to_text(F.col(text)))), doc, together=True)
    tokens = J.drop_stopwords(tokens.filter(~X.is_short(F.col("token"))), stops, spread=[doc, "pos"], **join)
    tagged = J.lexicon_join(tokens, lemmas.select("word", "lemma"), spread=[doc, "pos"], **join)
    code = X.is_code(F.col("token"))
    if pos is not None:
        tags = pos.select("word", F.col("pos").alias("tag"))
        tagged = J.lexicon_join(tagged, tags, spread=[doc, "pos"], **join).filter(code | F.col("tag").startswith("NN"))
    word = F.when(code, F.upper("token")).otherwise(F.coalesce("lemma", "token"))
    kept = J.regroup_tokens(tagged, doc, word)
    return df.select(doc).join(kept, doc, "left").select(
        doc, F.coalesce(X.join_tokens(F.col("tokens")), F.lit("")).alias(out)
    )


def clean_nouns_by_lexicon(
    df: DataFrame, key: str, text: Column, lexicon: DataFrame, stops: Sequence[str] = CLEANING, out: str = "clean", **join
) -> DataFrame:
    """``clean_nouns`` with parts of speech and noun lemmas from a table of any size, and the rules for other words."""
    kept = F.filter(X.split_tokens(X.basic_cleanup(text)), lambda w: _kept(w, stops))
    found = look_up(once(df, "_tokens", kept), key, F.col("_tokens"), lexicon, only=("pos", "noun"), cheap=True, **join)
    said = Found(lexicon)

    def shaped(w: Column, i: Column) -> Column:
        code = X.is_code(w)
        noun = F.when(said.pos(w, i).isin("NOUN", "PROPN") | said.pos(w, i).startswith("NN"), said.noun(w, i))
        return F.when(code, F.upper(w)).otherwise(noun)

    words = F.filter(F.transform("_tokens", shaped), lambda w: w.isNotNull())
    return found.withColumn(out, X.join_tokens(words)).drop("_tokens", "_found")


def lemmatize_by_lexicon(df: DataFrame, key: str, tokens: Column, lexicon: DataFrame, out: str = "lemmas", **join) -> DataFrame:
    """Add the tokens' noun lemmas as an array: those of a table of any size, by the rules for other words."""
    found = look_up(once(df, "_tokens", tokens), key, F.col("_tokens"), lexicon, only=("noun",), cheap=True, **join)
    return found.withColumn(out, F.transform("_tokens", Found(lexicon).noun)).drop("_tokens", "_found")


def keep_pos_by_lexicon(
    df: DataFrame,
    key: str,
    text: Column,
    lexicon: DataFrame,
    kept: Sequence[str] = W.KEPT_POS,
    out: str = "kept",
    keep: Sequence[str] | None = None,
    **join,
) -> DataFrame:
    """``keep_pos`` with parts of speech from a table of any size, and the rules for other words.

    ``keep`` names the columns that are wanted beside the new one, all without; the others are neither stored nor moved.
    """
    found = once(df, "_tokens", X.word_tokens(text))
    found = found if keep is None else found.select(*keep, "_tokens")
    found = look_up(found, key, F.transform("_tokens", F.lower), lexicon, only=("pos",), cheap=True, **join)
    said = Found(lexicon)
    words = F.filter("_tokens", lambda w, i: said.pos(F.lower(w), i).isin(list(kept)))
    return found.withColumn(out, X.join_tokens(words)).drop("_tokens", "_found")


def preprocess_text(
    df: DataFrame,
    text_col: str | None = None,
    candidates: Sequence[str] = W.TEXT_COLUMNS,
    min_tokens: int = 0,
    use_pos: bool = True,
    stops: Sequence[str] = CLEANING,
    tagger: Callable | None = None,
) -> tuple[DataFrame, str]:
    """Add ``clean`` from the chosen or detected text column; drop rows with fewer tokens than asked."""
    column = text_col or S.detect_text_column(df, candidates)
    text = X.to_text(F.col(column))
    if use_pos and tagger is not None:
        cleaned = clean_nouns_tagged(df, text, tagger, stops)
    else:
        cleaned = once(df, "clean", clean_nouns(text, stops) if use_pos else clean_simple(text, stops))
    return S.filter_min_tokens(cleaned, "clean", min_tokens), column


def add_word_count(df: DataFrame, text_col: str, out_col: str = "word_count") -> DataFrame:
    """Word runs of the raw text."""
    return df.withColumn(out_col, X.word_run_count(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def keep_pos(text: Column, kept: Sequence[str] = W.KEPT_POS) -> Column:
    """Words with one of the parts of speech, as they stand; marks are no words, glued to one or alone."""
    words = F.transform(X.word_tokens(text), lambda w: F.struct(w.alias("word"), F.lower(w).alias("low")))
    tokens = F.filter(words, lambda t: L.pos_tag(t["low"]).isin(list(kept)))
    return X.join_tokens(F.transform(tokens, lambda t: t["word"]))
