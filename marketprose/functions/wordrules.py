"""Words and marks of running text, by the word rules of the Penn Treebank.

Marks stand alone, contractions come apart (``don't``: ``do``, ``n't``), a period stays with its word unless a sentence ends
there. All rules look at one chunk, a stretch without white space, so a chunk that occurs often is split once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketprose.functions.text import SPACE, WORD

# The marks that always stand alone, what may follow the period of a sentence, and the joined words.
MARKS = r";@#$%&?!*()\[\]{}<>\"`«»“”„‘’"
CLOSING = r"\])}>\"'»”’"
JOINED = (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"))

PERIOD = rf"[^.]\.[{CLOSING}]*\z"
_PIECE = (
    rf"\.{{2,}}|--|''|[{MARKS}]|[:,](?!\p{{Nd}})"
    rf"|(?:[^{MARKS}.:,'\-{SPACE}]++|\.(?!\.)|[:,](?=\p{{Nd}})|'(?!')|-(?!-))++"
)
_JOINED = "|".join(rf"{a}(?={b}(?![{WORD}]))" for a, b in JOINED)


def chunks(text: Column) -> Column:
    """The stretches without white space, in order."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def period_word(chunk: Column) -> Column:
    """The word before a chunk's closing period, or the chunk's word if there is none, in lower case; '' if it has no word."""
    bare = F.regexp_replace(F.lower(chunk), rf"^[^{WORD}]+|\.?[^{WORD}.]*\z", "")
    return F.when(bare.rlike(r"^\p{Nd}+([.,]\p{Nd}+)*\z"), F.lit("0")).otherwise(bare)


def chunk_words(chunk: Column, ends: Column) -> Column:
    """Words and marks of a chunk, in order; ``ends`` says that its closing period ends a sentence."""
    opened = F.when(ends, F.regexp_replace(chunk, rf"([^.])\.([{CLOSING}]*)\z", "$1 . $2")).otherwise(chunk)
    pieces = F.array_join(F.regexp_extract_all(opened, F.lit(_PIECE), F.lit(0)), " ")
    apart = pieces
    for pattern, parts in (
        (rf"'([^\P{{L}}dmnstDMNST]|[\p{{N}}_])([^{WORD}]|\z)", "' $1$2"),
        (r"([^' ])('[sSmMdD]?)( |\z)", "$1 $2$3"),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |\z)", "$1 $2$3"),
        (rf"(?i)(?<![^ ])('t)(?=(?:is|was)(?![{WORD}]))", "$1 "),
    ):
        apart = F.regexp_replace(apart, pattern, parts)
    spaced = F.when(chunk.rlike(rf"^[{WORD}]+\z"), chunk).when(chunk.contains("'"), apart).otherwise(pieces)
    return F.filter(F.split(F.regexp_replace(spaced, rf"(?i)(?<![{WORD}])({_JOINED})", "$1 "), " "), lambda w: w != "")
