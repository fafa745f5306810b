"""Which periods end sentences, learned from the texts themselves.

Abbreviations are found without labels, by how strongly a word clings to a period (Kiss and Strunk 2006): a log-likelihood
ratio over the counts of the word with and without a period, weighed by its length and its inner periods. The counts are one
aggregation; a word's score depends on its own counts and two totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions import wordrules as R
from marketprose.functions.text import WORD
from marketprose.operators.lookups import keyed_join

MIN_SCORE = 0.3  # fixed value of the published method
ALWAYS = 0.99  # fixed value: how often an abbreviation has its period


def period_counts(chunks: DataFrame) -> DataFrame:
    """(word, dotted, bare): occurrences of each word with a closing period and without, from (chunk, n).

    Numbers count as one word. Words are in lower case.
    """
    dotted = F.col("chunk").rlike(R.PERIOD)
    words = chunks.select(R.period_word(F.col("chunk")).alias("word"), dotted.alias("dotted"), "n").filter("word <> ''")
    return words.groupBy("word").agg(
        F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("dotted"),
        F.sum(F.when(F.col("dotted"), 0).otherwise(F.col("n"))).alias("bare"),
    )


def clinging(dotted: Column, bare: Column, periods: Column, total: Column) -> Column:
    """Log-likelihood ratio of 'the word takes its period nearly always' to 'as often as any word does'."""
    p = periods / total
    odds = dotted * F.log(F.lit(ALWAYS) / p) + bare * F.log(F.lit(1 - ALWAYS) / (1 - p))
    return F.when(periods < total, 2 * odds).otherwise(F.lit(0.0))


def abbreviations(counts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(word, score) of the words that are abbreviations, from a written table of ``period_counts``; it is read twice.

    Short words and words with inner periods score higher; each occurrence without a period divides by the length.
    """
    sums = counts.agg(F.sum("dotted"), F.sum(F.col("dotted") + F.col("bare"))).first()
    periods, total = (F.lit(float(n or 0)) for n in sums)
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    length = F.length("word") - inner
    likely = clinging(F.col("dotted"), F.col("bare"), periods, total)
    score = likely * F.exp(-length) * (inner + 1) * F.pow(length, -F.col("bare"))
    dotted = counts.filter("dotted > 0 AND word <> '0'")
    return dotted.select("word", score.alias("score")).filter(F.col("score") >= min_score)


def with_ends(chunks: DataFrame, abbreviated: DataFrame, **join) -> DataFrame:
    """Add ``ends``: whether the closing period of (chunk, last) ends a sentence.

    Inside a text it does not after an abbreviation, an initial or a number; at the end of a text it always does.
    """
    word = R.period_word(F.col("chunk"))
    dotted = F.col("chunk").rlike(R.PERIOD)
    known = abbreviated.select(F.col("word").alias("_word"), F.lit(True).alias("_short")).distinct()
    keyed = chunks.withColumn("_word", F.when(dotted & ~F.col("last"), word))
    found = keyed_join(keyed, known, "_word", "left", **join)
    inside = F.col("_short").isNull() & ~F.col("_word").rlike(rf"^\p{{L}}\z") & (F.col("_word") != "0")
    return found.withColumn("ends", dotted & (F.col("last") | F.coalesce(inside, F.lit(False)))).drop("_word", "_short")
