"""Lemma, part-of-speech and valence look-ups for word lists that sit in the plan, and the ending rules.

Membership tests become hash-set probes, so the cost per word does not grow with the list. Tables
that are DataFrames, of any size, go through ``operators.lexicon``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from marketprose.functions import text as X
from marketprose.functions import words as W


def choose(word: Column, groups: Mapping[object, Iterable[str]], default: Column) -> Column:
    """The key of the first group holding the word."""
    out = None
    for value, members in groups.items():
        test = word.isin(list(members))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return default if out is None else out.otherwise(default)


def by_value(table: Mapping[str, object]) -> dict[object, list[str]]:
    groups: dict[object, list[str]] = {}
    for word, value in table.items():
        groups.setdefault(value, []).append(word)
    return groups


def _exceptions(word: Column, table: Mapping[str, str], ruled: Column) -> Column:
    # one hash probe sends ordinary words straight to the rules
    return F.when(word.isin(list(table)), choose(word, by_value(table), word)).otherwise(ruled)


def _drop(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _ends(word: Column, endings: Iterable[str]) -> Column:
    test = F.lit(False)
    for ending in endings:
        test = test | word.endswith(ending)
    return test


def noun_rules(word: Column) -> Column:
    """Singular form by ordered ending rules, else the word."""
    return (
        F.when(~word.endswith("s"), word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(_drop(word, 3), F.lit("y")))
        .when(_ends(word, ("ss", "us", "is")), word)
        .when(_ends(word, ("sses", "shes", "ches", "xes", "zes")), _drop(word, 2))
        .when(word.endswith("s") & (F.length(word) > 3), _drop(word, 1))
        .otherwise(word)
    )


def noun_lemma(word: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Singular form: the exception table first, then the rules."""
    return _exceptions(word, W.NOUN_LEMMAS if exceptions is None else exceptions, noun_rules(word))


def verb_rules(word: Column) -> Column:
    """Base form by ordered ending rules, else the word."""
    return (
        F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(_drop(word, 3), F.lit("y")))
        .when(word.endswith("ied") & (F.length(word) > 4), F.concat(_drop(word, 3), F.lit("y")))
        .when(_ends(word, ("sses", "shes", "ches", "xes", "zes")), _drop(word, 2))
        .when(word.endswith("ing") & (F.length(word) > 5), _drop(word, 3))
        .when(word.endswith("ed") & (F.length(word) > 4), _drop(word, 2))
        .when(_ends(word, ("ss", "us", "is")), word)
        .when(word.endswith("s") & (F.length(word) > 3), _drop(word, 1))
        .otherwise(word)
    )


def verb_lemma(word: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Base form: the exception table first, then the rules."""
    return _exceptions(word, W.VERB_LEMMAS if exceptions is None else exceptions, verb_rules(word))


def pos_rules(word: Column) -> Column:
    """Coarse part of speech of a lower-case word by digits and ending rules, else NOUN."""
    ruled = F.when(~X.starts_plain(word) & word.rlike(r"^\p{N}"), F.lit("NUM"))
    for endings, min_length, tag in W.POS_ENDINGS:
        ruled = ruled.when(_ends(word, endings) & (F.length(word) >= min_length), F.lit(tag))
    return ruled.otherwise(F.lit("NOUN"))


def pos_tag(word: Column, lexicon: Mapping[str, Iterable[str]] | None = None) -> Column:
    """Coarse part of speech of a lower-case word: the lexicon first, then the rules."""
    table = W.POS_WORDS if lexicon is None else lexicon
    known = [w for members in table.values() for w in members]
    # one hash probe sends words outside the lexicon straight to the rules
    return F.when(word.isin(known), choose(word, table, F.lit("NOUN"))).otherwise(pos_rules(word))


def token_lemma(word: Column, pos: Column) -> Column:
    """Verb lemma for verbs and auxiliaries, noun lemma for nouns, else the word."""
    return (
        F.when(pos.isin("VERB", "AUX"), verb_lemma(word)).when(pos == "NOUN", noun_lemma(word)).otherwise(word)
    )


def valence(word: Column, table: Mapping[str, float] | None = None) -> Column:
    """Valence of a lower-case word, 0 when it has none."""
    table = W.VALENCE if table is None else table
    groups = {float(v): members for v, members in by_value(table).items()}
    return F.when(word.isin(list(table)), choose(word, groups, F.lit(0.0))).otherwise(F.lit(0.0))
