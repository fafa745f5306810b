"""Keyword counts and word-cloud weights. No text is ever joined to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.functions import text as X
from marketprose.functions import wordrules as R
from marketprose.operators import sentences as E
from marketprose.operators.lookups import drop_stopwords, keyed_join
from marketprose.operators.select import once, unnest
from marketprose.operators.stopwords import KEYWORDS
from marketprose.session import written

KEYWORD_TOKEN = rf"[{X.WORD}$]+"  # for token rows without sentences


def appearance(tokens: DataFrame, doc: str) -> Column:
    """A value that sorts tokens by (doc, pos).

    For whole-number documents it is one number, which keeps the aggregation on hashes; array
    positions stay below 10^10.
    """
    if dict(tokens.dtypes)[doc] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(doc).cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    return F.struct(doc, "pos")


def chunk_counts(df: DataFrame, text: str, doc: str, lowercase: bool = True) -> DataFrame:
    """Each distinct chunk (chunk, last, n, first): ``last`` marks a period that a text ends with, ``first`` sorts by the
    earliest (doc, pos). Nulls hold no chunks."""
    value = F.lower(F.col(text)) if lowercase else F.col(text)
    held = once(df.select(doc, value.alias("_t")), "_c", R.chunks(F.col("_t")))
    rows = held.select(doc, F.size("_c").alias("size"), F.posexplode("_c").alias("pos", "chunk"))
    last = (F.col("pos") == F.col("size") - 1) & F.col("chunk").rlike(R.PERIOD)
    return rows.groupBy("chunk", last.alias("last")).agg(F.count("*").alias("n"), F.min(appearance(rows, doc)).alias("first"))


def keyword_counts(
    df: DataFrame,
    text: str,
    doc: str,
    lowercase: bool = True,
    alpha_only: bool = True,
    abbreviated: DataFrame | None = None,
) -> DataFrame:
    """(word, freq, first) of all words; ``first`` sorts by the earliest (doc, chunk, place in the chunk).

    Texts become counts of distinct chunks first; sentence ends and words are worked out once per chunk.
    ``abbreviated`` is a table (``word``, lower case, without the closing period); by default it is learned from the texts.
    """
    counted = written(chunk_counts(df, text, doc, lowercase), "keyword-chunks")
    if abbreviated is None:
        abbreviated = E.abbreviations(written(E.period_counts(counted), "period-counts"))
    ended = E.with_ends(counted, abbreviated, spread=["chunk"])
    words = unnest(ended, ["n", "first"], R.chunk_words(F.col("chunk"), F.col("ends")), "place", "word")
    words = words.filter(X.is_alpha(F.col("word"))) if alpha_only else words
    return words.groupBy("word").agg(F.sum("n").alias("freq"), F.min(F.struct("first", "place")).alias("first"))


def top_keywords(counts: DataFrame, topn: int = 20) -> DataFrame:
    """The most frequent words; equals keep the order of first appearance."""
    return counts.orderBy(F.desc("freq"), "first").limit(topn).select("word", "freq")


def keyword_frequency(
    df: DataFrame,
    text: str,
    doc: str,
    stops: Sequence[str] | DataFrame = KEYWORDS,
    topn: int = 20,
    lowercase: bool = True,
    alpha_only: bool = True,
    abbreviated: DataFrame | None = None,
) -> DataFrame:
    """Top-n words (word, freq). ``stops`` is a word list, or a table for long ones."""
    counts = keyword_counts(df, text, doc, lowercase, alpha_only, abbreviated)
    if isinstance(stops, DataFrame):
        counts = drop_stopwords(counts, stops, "word")
    elif stops:
        counts = counts.filter(~F.col("word").isin(list(stops)))
    return top_keywords(counts, topn)


# ---- word cloud ---------------------------------------------------------------


def cloud_words(text: Column, min_word_length: int = 0, include_numbers: bool = False) -> Column:
    """Words with inner apostrophes, a trailing 's cut off, bare numbers dropped."""
    tail = "*" if min_word_length <= 1 else "+"
    words = F.regexp_extract_all(text, F.lit(rf"[{X.WORD}][{X.WORD}']{tail}"), F.lit(0))
    words = F.transform(words, lambda w: F.when(F.lower(w).endswith("'s"), F.left(w, F.length(w) - 2)).otherwise(w))
    if not include_numbers:
        words = F.filter(words, lambda w: ~w.rlike(r"^\p{Nd}+\z"))
    return F.filter(words, lambda w: F.length(w) >= min_word_length) if min_word_length > 0 else words


def cloud_forms(
    df: DataFrame, text: str, doc: str, stops: Sequence[str], pairs: bool, min_word_length: int = 0, include_numbers: bool = False
) -> DataFrame:
    """(form, n, first): spellings of words that are no stop words and, with ``pairs``, of two such words in a row.

    Each text is split once; words and pairs are counted by one aggregation.
    """
    stops = [w.lower() for w in stops]
    words = once(df.select(doc, text), "_w", cloud_words(F.col(text), min_word_length, include_numbers))
    after = F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1)))
    joined = F.zip_with("_w", after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    tokens = once(words, "_p", joined).select(doc, F.posexplode("_p").alias("pos", "p"))
    tokens = tokens.filter(~F.lower("p.a").isin(stops))
    word, second = F.col("p.a"), F.col("p.b")
    if pairs:
        pair = F.when(second.isNotNull() & ~F.lower(second).isin(stops), F.array(word, F.concat_ws(" ", word, second)))
        tokens = tokens.select(doc, "pos", F.explode(F.coalesce(pair, F.array(word))).alias("form"))
    else:
        tokens = tokens.select(doc, "pos", word.alias("form"))
    return tokens.groupBy("form").agg(F.count("*").alias("n"), F.min(appearance(tokens, doc)).alias("first"))


def fold_forms(forms: DataFrame, normalize_plurals: bool = True) -> DataFrame:
    """Fold case and simple plurals: (key, standard, total) for every lower-case key.

    The standard form of a key is its commonest spelling, the earliest of equals. A key that ends in
    one s and also occurs without it takes the standard form and the total of the singular.

    A word and its plural share ``stem``; rows move once, by stem, and every later step groups by
    stem and more. A group is the spellings of one word.
    """
    key = F.lower("form")
    one_s = key.endswith("s") & ~key.endswith("ss") & F.lit(normalize_plurals)
    keyed = forms.withColumns(
        {"key": key, "one_s": one_s, "stem": F.when(one_s, F.left(key, F.length(key) - 1)).otherwise(key)}
    )
    has_singular = F.max(~F.col("one_s")).over(Window.partitionBy("stem"))
    folded = keyed.withColumn("plural", F.col("one_s") & has_singular)
    cut = lambda c: F.when(F.col("plural"), F.left(c, F.length(c) - 1)).otherwise(F.col(c))
    spelled = folded.select(
        "stem", cut("key").alias("base"), cut("form").alias("spelling"), "n", F.struct("plural", "first").alias("seen")
    )
    merged = spelled.groupBy("stem", "base", "spelling").agg(
        F.sum("n").alias("n"), F.min("seen").alias("seen"), F.max("seen.plural").alias("plural")
    )
    standard = merged.groupBy("stem", "base").agg(
        F.min_by("spelling", F.struct((-F.col("n")).alias("n"), "seen")).alias("standard"),
        F.sum("n").alias("total"),
        F.max("plural").alias("plural"),
    )
    keys = F.when(F.col("plural"), F.array("base", F.concat("base", F.lit("s")))).otherwise(F.array("base"))
    return standard.select(F.explode(keys).alias("key"), "standard", "total")


def log_likelihood(pair: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's collocation score of a word pair."""
    tiny = F.lit(1e-10)

    def part(k: Column, m: Column, x: Column) -> Column:
        return F.log(F.greatest(x, tiny)) * k + F.log(F.greatest(1 - x, tiny)) * (m - k)

    p, p1, p2 = second / n, pair / first, (second - pair) / (n - first)
    score = part(pair, first, p) + part(second - pair, n - first, p)
    score = score - part(pair, first, p1) - part(second - pair, n - first, p2)
    return F.when((n > first) & (n > second), -2 * score).otherwise(F.lit(0.0))


def cloud_counts(
    df: DataFrame,
    text: str,
    doc: str,
    stops: Sequence[str] = KEYWORDS,
    collocations: bool = True,
    normalize_plurals: bool = True,
    threshold: float = 30,
    min_word_length: int = 0,
    include_numbers: bool = False,
) -> DataFrame:
    """(term, freq) of words and word pairs; a pair that scores above the threshold is a term of its
    own and is taken off the counts of its words. Pairs never cross documents."""
    forms = cloud_forms(df, text, doc, stops, collocations, min_word_length, include_numbers)
    folded = fold_forms(forms, normalize_plurals)  # a pair holds a space and no word does, so both fold together
    by_term = lambda keys: keys.groupBy(F.col("standard").alias("term")).agg(F.first("total").alias("freq"))
    if not collocations:
        return by_term(folded)
    folded = written(folded, "cloud-folded")
    is_pair = F.contains("key", F.lit(" "))
    words = folded.filter(~is_pair)
    counts = by_term(words)
    n = F.coalesce(counts.agg(F.sum("freq")).scalar(), F.lit(0))
    part = lambda i: F.lower(F.split_part("term", F.lit(" "), F.lit(i)))
    two = by_term(folded.filter(is_pair)).withColumns({"k1": part(1), "k2": part(2)})
    for side in ("1", "2"):
        one = words.select(F.col("key").alias("k" + side), F.col("standard").alias("w" + side), F.col("total").alias("c" + side))
        # written: a join too large for a broadcast reads its rows twice, and the second would repeat the first
        two = keyed_join(written(two, "cloud-pairs"), written(one, "cloud-words"), "k" + side, "inner", spread=["term"])
    score = log_likelihood(F.col("freq"), F.col("c1"), F.col("c2"), n)
    strong = written(two.filter(score > threshold).select("term", "freq", "w1", "w2"), "cloud-strong")
    taken = (
        strong.select(F.explode(F.array("w1", "w2")).alias("term"), "freq")
        .groupBy("term")
        .agg(F.sum("freq").alias("taken"))
    )
    rest = counts.join(taken, "term", "left").select("term", (F.col("freq") - F.coalesce("taken", F.lit(0))).alias("freq"))
    return rest.filter("freq > 0").union(strong.select("term", "freq"))


def cloud_weights(df: DataFrame, text: str, doc: str, max_words: int = 100, **options) -> DataFrame:
    """The heaviest terms with their weight relative to the maximum: (term, freq, weight)."""
    top = cloud_counts(df, text, doc, **options).orderBy(F.desc("freq"), "term").limit(max_words)
    top = written(top, "cloud-top")
    return top.withColumn("weight", F.col("freq") / top.agg(F.max("freq")).scalar())
