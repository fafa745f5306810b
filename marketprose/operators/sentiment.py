"""Lexicon sentiment: valence, boosters, negation, capitals, "but", punctuation.

One text is one row; its score is a single expression over the row's own words, so nothing is
shuffled. Only words with a valence are visited.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.functions import words as W
from marketprose.operators.lexicon import look_up
from marketprose.operators.select import once

_ASCII_PUNCT = r"!-/:-@\[-`{-~"
_MARK = r"(?:[.!?,;:\-'\"]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"


def sentiment_words(text: Column) -> Column:
    """Whitespace tokens of two or more characters; one mark before or after a plain word is cut off."""
    tokens = F.filter(F.split(text, f"[{X.SPACE}]+"), lambda w: F.length(w) > 1)
    plain = rf"[^{_ASCII_PUNCT}]{{2,}}"
    cut = lambda w: F.regexp_replace(F.regexp_replace(w, rf"^{_MARK}({plain})\z", "$1"), rf"^({plain}){_MARK}\z", "$1")
    return F.transform(tokens, lambda w: F.when(w.rlike(f"[{_ASCII_PUNCT}]"), cut(w)).otherwise(w))


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _boost(word: Column) -> Column:
    return (
        F.when(word.isin(list(W.BOOST_UP)), F.lit(W.BOOST))
        .when(word.isin(list(W.BOOST_DOWN)), F.lit(-W.BOOST))
        .otherwise(F.lit(0.0))
    )


def _negates(word: Column) -> Column:
    return word.isin(list(W.NEGATIONS)) | word.contains("n't")


def _idiom(words: Column, i: Column, value: Column) -> Column:
    """An idiom around word i sets the value; "kind of" and its like just before dampen it."""

    def phrase(start: int, end: int) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + j) for j in range(start, end + 1)])

    found = F.lit(None).cast("double")
    for start, end in ((-3, -2), (-3, -1), (-2, -1), (-2, 0), (-1, 0)):
        hit = L.choose(phrase(start, end), L.by_value(W.IDIOMS), F.lit(None).cast("double"))
        found = F.coalesce(hit, found)
    for end in (1, 2):
        hit = L.choose(phrase(0, end), L.by_value(W.IDIOMS), F.lit(None).cast("double"))
        found = F.coalesce(F.when(F.size(words) > i + end, hit), found)
    dampers = list(W.BOOST_DOWN_PHRASES)
    damped = phrase(-3, -2).isin(dampers) | phrase(-2, -1).isin(dampers)
    return F.coalesce(found, value) - F.when(damped, W.BOOST).otherwise(0.0)


class Inline:
    """Valences of a word list that sits in the plan."""

    def __init__(self, table: Mapping[str, float]):
        self.table = table

    def value(self, low: Column, i: Column) -> Column:
        return L.valence(F.get(low, i), self.table)

    def lists(self, low: Column, i: Column) -> Column:
        return F.coalesce(F.get(low, i).isin(list(self.table)), F.lit(False))


class LookedUp:
    """Valences found in a table, one per word of the text."""

    def __init__(self, found: str = "_found"):
        self.found = found

    def value(self, low: Column, i: Column) -> Column:
        return F.get(self.found, i)["valence"]

    def lists(self, low: Column, i: Column) -> Column:
        return self.value(low, i).isNotNull()


def first_places(slots: Column) -> Column:
    """For (w, p) pairs by p: (p, first), the place at which the same word comes first; n log n steps."""

    def grouped(by_word: Column) -> Column:
        fresh = lambda j: (j == 0) | (F.get(by_word, j - 1)["w"] != F.get(by_word, j)["w"])
        begin = F.filter(F.transform(by_word, lambda _, j: F.when(fresh(j), j)), lambda j: j.isNotNull())

        def group(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(by_word))
                first = F.get(by_word, start)["p"]
                return F.transform(F.slice(by_word, start + 1, end - start), lambda s: F.struct(s["p"].alias("p"), first.alias("first")))

            return F.array_sort(F.flatten(F.transform(starts, one)))

        return X.bind(begin, group)

    return X.bind(F.array_sort(slots), grouped)


def _word_score(words: Column, low: Column, mixed_case: Column, i: Column, table: Inline | LookedUp) -> Column:
    def step(d: int, value: Column) -> Column:
        prev = F.get(low, i - d)
        sign = F.when(value < 0, -1.0).otherwise(1.0)
        boost = _boost(prev)
        shout = F.when((boost != 0) & _is_upper(F.get(words, i - d)) & mixed_case, W.CAPS_BOOST).otherwise(0.0)
        boosted = value + sign * (boost + shout) * W.DAMPING[d - 1]
        exact = lambda j, *options: F.get(words, i - j).isin(list(options))
        if d == 1:
            factor = F.when(_negates(prev), W.NEGATION).otherwise(1.0)
        elif d == 2:
            never = exact(2, "never") & exact(1, "so", "this")
            factor = F.when(never, 1.5).when(_negates(prev), W.NEGATION).otherwise(1.0)
        else:
            never = (exact(3, "never") & exact(2, "so", "this")) | exact(1, "so", "this")
            factor = F.when(never, 1.25).when(_negates(prev), W.NEGATION).otherwise(1.0)
        out = boosted * factor
        if d == 3:
            out = X.bind(out, lambda v: _idiom(words, i, v))
        return F.when((i >= d) & ~table.lists(low, i - d), out).otherwise(value)

    base = table.value(low, i)
    shout = F.when(_is_upper(F.get(words, i)) & mixed_case, W.CAPS_BOOST).otherwise(0.0)
    value = X.bind(base, lambda v: v + F.when(v > 0, shout).otherwise(-shout))
    for d in (1, 2, 3):
        value = X.bind(value, partial(step, d))
    before = F.get(low, i - 2)
    least = (i > 0) & (F.get(low, i - 1) == "least") & ((i == 1) | ~before.isin("at", "very"))
    value = value * F.when(least & ~table.lists(low, i - 1), W.NEGATION).otherwise(1.0)
    kind_of = (F.get(low, i) == "kind") & (F.coalesce(F.get(low, i + 1), F.lit("")) == "of")
    skipped = kind_of | F.get(low, i).isin([*W.BOOST_UP, *W.BOOST_DOWN])
    return F.when(skipped, 0.0).otherwise(value)


def _emphasis(text: Column) -> Column:
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(4)) * 0.292
    asks = F.regexp_count(text, F.lit(r"\?"))
    return marks + F.when(asks <= 1, 0.0).when(asks <= 3, asks * 0.18).otherwise(0.96)


def compound_score(text: Column, table: Mapping[str, float] | LookedUp | None = None) -> Column:
    """Compound score in -1..1, four decimals; null text scores 0.

    A repeated word takes the surroundings of its first occurrence, as the published tool does.
    """
    return F.when(text.isNull(), 0.0).otherwise(_compound(sentiment_words(text), _emphasis(text), table))


def _compound(found: Column, emphasis: Column, table: Mapping[str, float] | LookedUp | None) -> Column:
    """The score of a text that is not null, from its words and the weight of its marks."""
    table = table if isinstance(table, LookedUp) else Inline(W.VALENCE if table is None else table)

    def scored(words: Column) -> Column:
        capitals = F.size(F.filter(words, _is_upper))
        mixed = (capitals > 0) & (capitals < F.size(words))

        def with_low(low: Column) -> Column:
            def with_case(mixed_case: Column) -> Column:
                slots = F.filter(
                    F.transform(words, lambda w, p: F.when(table.lists(low, p), F.struct(w.alias("w"), p.alias("p")))),
                    lambda s: s.isNotNull(),
                )
                but = F.array_position(low, "but") - 1

                def one(slot: Column) -> Column:
                    p, first = slot["p"], slot["first"]
                    raw = X.bind(first, lambda i: _word_score(words, low, mixed_case, i, table))
                    return raw * F.when((but < 0) | (p == but), 1.0).when(p < but, 0.5).otherwise(1.5)

                return F.aggregate(F.transform(first_places(slots), one), F.lit(0.0), lambda a, x: a + x)

            return X.bind(mixed, with_case)

        return X.bind(F.transform(words, F.lower), with_low)

    def compound(total: Column) -> Column:
        moved = total + F.when(total > 0, emphasis).when(total < 0, -emphasis).otherwise(0.0)
        return X.bind(moved, lambda s: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + W.NORMAL_ALPHA))), 4))

    return X.bind(X.bind(found, scored), compound)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.05, "Positive").when(score <= -0.05, "Negative").otherwise("Neutral")


def add_sentiment(
    df: DataFrame,
    text: str = "content",
    table: Mapping[str, float] | DataFrame | None = None,
    key: str = "doc_id",
    keep: Sequence[str] | None = None,
    **join,
) -> DataFrame:
    """Add ``compound_score`` and ``sentiment_label``; the score is computed once.

    ``table`` is a word list or, for any size, a DataFrame (word, valence); words without a valence are not listed. With a
    DataFrame, ``key`` is unique; ``keep`` names the columns that are wanted beside the new ones, all without, and the others
    are neither stored nor moved.
    """
    if isinstance(table, DataFrame):
        listed = table.select("word", F.col("valence").cast("double").alias("valence")).filter("valence IS NOT NULL")
        held = once(df, "_ws", sentiment_words(F.coalesce(F.col(text), F.lit(""))))
        held = once(held, "_marks", F.when(F.col(text).isNotNull(), _emphasis(F.col(text))))
        held = held if keep is None else held.select(*keep, "_ws", "_marks")
        found = look_up(held, key, F.transform("_ws", F.lower), listed, cheap=True, **join)
        score = F.when(F.col("_marks").isNull(), 0.0).otherwise(_compound(F.col("_ws"), F.col("_marks"), LookedUp()))
        scored = once(found, "compound_score", score).drop("_ws", "_marks", "_found")
    else:
        scored = once(df, "compound_score", compound_score(F.col(text), table))
        scored = scored if keep is None else scored.select(*keep, "compound_score")
    return scored.withColumn("sentiment_label", sentiment_label(F.col("compound_score")))
