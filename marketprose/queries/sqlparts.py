"""SQL expressions for the checking side, written independently of the Spark operators."""

from __future__ import annotations

from collections.abc import Iterable

from marketprose.functions import words as W
from marketprose.queries import inputs as I

SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^[{SP}]+|[{SP}]+\z", "")


def to_text(x: str) -> str:
    return strip(f"coalesce(CAST({x} AS VARCHAR), '')")


def urls(x: str) -> str:
    return sub(x, rf"http[^{SP}]+|www\.[^{SP}]+", " ")


def mentions(x: str) -> str:
    return sub(x, f"@[{WD}]+", " ")


def emoji(x: str) -> str:
    ranges = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in W.EMOJI_RANGES)
    return sub(x, f"[{ranges}]+", " ")


def punctuation(x: str) -> str:
    return sub(x, f"[^{WD}{SP}$]", " ")


def spaces(x: str) -> str:
    return f"trim({sub(x, f'[{SP}]+', ' ')})"


def cleanup(x: str) -> str:
    return spaces(punctuation(emoji(mentions(urls(f"lower({x})")))))


def split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{SP}]+')}), lambda w: w <> '')"


def runs(x: str) -> str:
    return f"regexp_extract_all({x}, {q(f'[{WD}]+')})"


def noun(x: str) -> str:
    """CASE over the exception table and the ending rules."""
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in W.NOUN_LEMMAS.items())
    return f"CASE {x} {cases} ELSE {noun_rules(x)} END"


def noun_rules(x: str) -> str:
    return f"""CASE
      WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN concat({x}[:-4], 'y')
      WHEN regexp_matches({x}, '(ss|us|is)$') THEN {x}
      WHEN regexp_matches({x}, '(sses|shes|ches|xes|zes)$') THEN {x}[:-3]
      WHEN length({x}) > 3 AND {x} LIKE '%s' THEN {x}[:-2] ELSE {x} END"""


def verb(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in W.VERB_LEMMAS.items())
    return f"CASE {x} {cases} ELSE {verb_rules(x)} END"


def verb_rules(x: str) -> str:
    return f"""CASE
      WHEN length({x}) > 4 AND regexp_matches({x}, '(ies|ied)$') THEN concat({x}[:-4], 'y')
      WHEN regexp_matches({x}, '(sses|shes|ches|xes|zes)$') THEN {x}[:-3]
      WHEN length({x}) > 5 AND {x} LIKE '%ing' THEN {x}[:-4]
      WHEN length({x}) > 4 AND {x} LIKE '%ed' THEN {x}[:-3]
      WHEN regexp_matches({x}, '(ss|us|is)$') THEN {x}
      WHEN length({x}) > 3 AND {x} LIKE '%s' THEN {x}[:-2] ELSE {x} END"""


def pos(x: str) -> str:
    cases = " ".join(f"WHEN {x} IN {words(ws)} THEN {q(tag)}" for tag, ws in W.POS_WORDS.items())
    return f"CASE {cases} ELSE {pos_rules(x)} END"


def pos_rules(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '^\p{{N}}') THEN 'NUM'
      WHEN length({x}) >= 4 AND regexp_matches({x}, 'ly$') THEN 'ADV'
      WHEN length({x}) >= 5 AND regexp_matches({x}, '(ing|ed)$') THEN 'VERB'
      WHEN length({x}) >= 5 AND regexp_matches({x}, '(ous|ful|able|ible|ish|less)$') THEN 'ADJ' ELSE 'NOUN' END"""


def code(x: str) -> str:
    return rf"({x} LIKE '$%' OR regexp_matches({x}, '^\p{{Nd}}+(m|b|%)?$'))"


def clean(x: str, stops: Iterable[str], nouns: bool) -> str:
    only = f" AND ({code('w')} OR {pos('w')} = 'NOUN')" if nouns else ""
    kept = f"list_filter({split(cleanup(x))}, lambda w: w NOT IN {words(stops)} AND length(w) > 2{only})"
    return f"array_to_string(list_transform({kept}, lambda w: CASE WHEN {code('w')} THEN upper(w) ELSE {noun('w')} END), ' ')"


def values(rows: Iterable[Iterable[str]], columns: str) -> str:
    body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"


def word_values(ws: Iterable[str], column: str = "word") -> str:
    return values([(q(w),) for w in ws], column)


def with_articles(rest: str) -> str:
    return f"WITH articles AS ({I.ARTICLES})\n{rest}"


def with_posts(rest: str) -> str:
    return f"WITH posts AS ({I.POSTS})\n{rest}"


def with_prices(rest: str) -> str:
    return f"WITH prices AS (SELECT *, strftime(d, '%Y%m%d') AS datetime FROM ({I.PRICES}))\n{rest}"


def with_items(rest: str) -> str:
    return f"WITH search_items AS ({I.SEARCH_ITEMS})\n{rest}"


def with_factors(rest: str) -> str:
    weights = "list_transform(embedding[1:8], lambda x: abs(CAST(x AS DOUBLE)))"
    return f"WITH factors AS ({I.FACTORS.format(weights=weights)})\n{rest}"


def split_case(day: str) -> str:
    """Name of the date range a day falls in."""
    cases = " ".join(f"WHEN {day} BETWEEN DATE '{start}' AND DATE '{end}' THEN '{name}'" for name, start, end in W.SPLIT_RANGES)
    return f"CASE {cases} ELSE 'exclude' END"


def kept_words(text: str) -> str:
    """Words with a kept part of speech."""
    return f"array_to_string(list_filter({spoken_words(text)}, lambda w: {pos('lower(w)')} IN {words(W.KEPT_POS)}), ' ')"


def spoken_words(text: str) -> str:
    """Addresses, numbers with separators, abbreviations, words with apostrophes."""
    blank = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
    kinds = [
        rf"(?:https?://|www\.)[^{blank}]*[^{blank}.,!?;:)\x{{22}}\x{{27}}]",
        r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"\p{N}+(?:[.,]\p{N}+)+",
        r"(?:\p{L}\.)(?:\p{L}\.)+",
        r"[\p{L}\p{N}_]+(?:[\x{27}’][\p{L}\p{N}_]+)*",
    ]
    return f"regexp_extract_all({text}, '{'|'.join(kinds)}')"
