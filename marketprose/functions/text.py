"""Scalar text functions: Column in, Column out, all inside Spark's expression engine.

Spark's ``\\w``, ``\\d`` and ``\\s`` cover ASCII only, so Unicode classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, functions as F

from marketprose.functions import words as W

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
URL_PATTERN = rf"http[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION_PATTERN = rf"@[{WORD}]+"
PUNCTUATION_PATTERN = rf"[^{WORD}{SPACE}$]"
CODE_PATTERN = r"^\p{Nd}+(m|b|%)?$"
URL_LIKE = r"^(?i)(https?://.+|www\..+|[a-z0-9][a-z0-9.-]*\.(com|org|net|edu|gov|io|co|uk|de|fr|es|info|biz)(/.*)?)$"
EMAIL_LIKE = r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$"

# What keep_cjk still erases of the last emoji range: symbols, private use, selectors, tiles.
_CJK_GAPS = ((0x24C2, 0x2E7F), (0xE000, 0xF8FF), (0xFE00, 0xFE0F), (0x1F000, 0x1F251))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def emoji_class(keep_cjk: bool = False) -> str:
    ranges = (*W.EMOJI_RANGES[:-1], *_CJK_GAPS) if keep_cjk else W.EMOJI_RANGES
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]+"


def strip_text(text: Column) -> Column:
    def strip(t: Column) -> Column:
        edges = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(edges.rlike(f"[{SPACE}]"), F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]++\z", "")).otherwise(t)

    return bind(text, strip)


def to_text(col: Column) -> Column:
    """Null becomes empty, anything else its trimmed text."""
    return strip_text(F.coalesce(col.cast("string"), F.lit("")))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, " ")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION_PATTERN, " ")


def strip_emoji(text: Column, keep_cjk: bool = False) -> Column:
    """Erase the emoji ranges; by default that also erases CJK, kana and Hangul letters."""
    return F.regexp_replace(text, emoji_class(keep_cjk), " ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION_PATTERN, " ")


def collapse_whitespace(text: Column) -> Column:
    # a lone space stays as it is
    return F.trim(F.regexp_replace(text, f"[[{SPACE}]&&[^ ]][{SPACE}]*+| [{SPACE}]++", " "))


def bare_text(text: Column, keep_cjk: bool = False) -> Column:
    """Lower-case, without URLs, mentions and emoji; a text that cannot hold any is not searched for them."""

    def step(test: Callable[[Column], Column], strip: Callable[[Column], Column], now: Column) -> Column:
        return F.when(test(now), strip(now)).otherwise(now)

    out = F.lower(text)
    for test, strip in (
        (lambda t: t.contains("http") | t.contains("www."), strip_urls),
        (lambda t: t.contains("@"), strip_mentions),
        (lambda t: F.octet_length(t) > F.length(t), partial(strip_emoji, keep_cjk=keep_cjk)),
    ):
        out = bind(out, partial(step, test, strip))
    return out


def cleanup_tokens(text: Column) -> Column:
    """Words of the text that ``basic_cleanup`` leaves, without writing that text."""
    return F.regexp_extract_all(bare_text(text), F.lit(f"(?:[a-z0-9_$]++|[{WORD}$])++"), F.lit(0))


def basic_cleanup(text: Column, keep_cjk: bool = False) -> Column:
    """Lower-case, then drop URLs, mentions, emoji and punctuation; single spaces remain."""
    return collapse_whitespace(strip_punctuation(bare_text(text, keep_cjk)))


def split_tokens(text: Column) -> Column:
    """Whitespace tokens; blank text gives an empty array."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0))


def word_run_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{WORD}]+")).cast("bigint")


def starts_plain(word: Column) -> Column:
    """Is the first character one of a-z? Two comparisons, so most words need no pattern."""
    return (word >= "a") & (word < "{")


def is_short(word: Column) -> Column:
    return F.length(word) <= 2


def is_code(word: Column) -> Column:
    """Cashtag or bare number, optionally with m, b or %."""
    return word.startswith("$") | (~starts_plain(word) & word.rlike(CODE_PATTERN))


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+\z")


def is_numeric(word: Column) -> Column:
    return word.rlike(r"^\p{N}+\z")


def has_ascii_word_char(word: Column) -> Column:
    return word.rlike("[a-z0-9_]")


def is_url_like(word: Column) -> Column:
    return word.rlike(URL_LIKE)


def is_email_like(word: Column) -> Column:
    return word.rlike(EMAIL_LIKE)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def without(tokens: Column, stops: Iterable[str]) -> Column:
    """Drop listed words, keeping order and repeats; Spark probes the list as a hash set."""
    stops = list(stops)
    return F.filter(tokens, lambda w: ~w.isin(stops)) if stops else tokens


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """Runs of n neighbouring tokens joined by ``sep``; empty when there are fewer than n."""
    return bind(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(t) - n),
                lambda i: F.concat_ws(sep, *[F.get(t, i + j) for j in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def ngram_range(tokens: Column, low: int, high: int, sep: str = " ") -> Column:
    """All n-grams for n in low..high, shorter ones first."""
    return bind(tokens, lambda t: F.concat(*[t if n == 1 else ngrams(t, n, sep) for n in range(low, high + 1)]))


def vectorizer_words(text: Column) -> Column:
    """Lower-cased word runs of two or more characters; ``$`` is not part of a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def count_words(text: Column) -> Column:
    """Runs of a-z, 0-9 and _ that touch no other letter or digit; no case folding."""
    return F.filter(word_runs(text), lambda w: w.rlike(r"^[a-z0-9_]+\z"))


# web or mail address, number with separators, dotted abbreviation, word with inner apostrophes; marks are none of these
WORD_TOKENS = (
    rf"(?:https?://|www\.)[^{SPACE}]*[^{SPACE}.,!?;:)\"']|[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    rf"|\p{{N}}+(?:[.,]\p{{N}}+)+|(?:\p{{L}}\.){{2,}}|[{WORD}]+(?:['’][{WORD}]+)*"
)


def word_tokens(text: Column) -> Column:
    """Words of a text without the marks around them."""
    # a word before none of these marks can start nothing else
    word = rf"(?>[A-Za-z0-9_]++(?:[{WORD}]++)?|[{WORD}]++)(?![.,@+:\-'’])"
    return F.regexp_extract_all(text, F.lit(rf"(?! )(?:{word}|{WORD_TOKENS})"), F.lit(0))
