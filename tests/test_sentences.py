"""Sentence ends, word rules and the keyword counts made from them, with values planted by construction."""

import math

import pytest
from pyspark.sql import functions as F

from marketprose.functions import wordrules as R
from marketprose.operators import keywords as K
from marketprose.operators import sentences as E

WORDS = {
    "": [], "plain": ["plain"], "$TSLA": ["$", "TSLA"], "long-term": ["long-term"], "U.S.": ["U.S."], "don't": ["do", "n't"],
    "it's": ["it", "'s"], "they'll": ["they", "'ll"], "WE'RE": ["WE", "'RE"], "dogs'": ["dogs", "'"], "cannot": ["can", "not"],
    "Gonna": ["Gon", "na"], "cannots": ["cannots"], "'tis": ["'t", "is"], "more'n": ["more", "'n"], "3,000.50": ["3,000.50"],
    "a,b": ["a", ",", "b"], "10:30": ["10:30"], "note:": ["note", ":"], "wait...": ["wait", "..."], "one--two": ["one", "--", "two"],
    '"(Hi)!"': ['"', "(", "Hi", ")", "!", '"'], "95%": ["95", "%"], "naïve": ["naïve"], "日本": ["日本"], "mid.dle": ["mid.dle"],
    "''x''": ["''", "x", "''"], "'x'": ["'", "x", "'"],
}


def split(spark, chunks, ends=False):
    df = spark.createDataFrame(list(enumerate(chunks)), "i int, c string").repartition(3)
    return [r["w"] for r in df.select("i", R.chunk_words(F.col("c"), F.lit(ends)).alias("w")).orderBy("i").collect()]


def test_words_of_chunks(spark):
    assert dict(zip(WORDS, split(spark, WORDS))) == WORDS


def test_a_sentence_end_takes_its_period_off(spark):
    cases = {"end.": ["end", "."], 'end.")': ["end", ".", '"', ")"], "U.S.": ["U.S", "."], "wait...": ["wait", "..."], "go!": ["go", "!"]}
    assert dict(zip(cases, split(spark, cases, True))) == cases


def test_very_long_chunks(spark):
    long = ["ab" * 500_000, "a'" * 50_000 + "b", "x," * 200_000, "." * 300_000, "-" * 100_001]
    got = split(spark, long)
    assert got[0] == [long[0]] and got[2] == ["x", ","] * 200_000 and got[3] == [long[3]] and len(got[4]) == 50_001


def test_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "a b.")], "id long, t string")
    assert {(r["chunk"], r["last"], r["n"]) for r in K.chunk_counts(df, "t", "id").collect()} == {("a", False, 1), ("b.", True, 1)}


def counts(spark, rows):
    return spark.createDataFrame(rows, "word string, dotted long, bare long")


def test_abbreviations_against_the_formula(spark):
    rows = [("etc", 40, 0), ("u.s", 30, 0), ("mr", 60, 1), ("end", 30, 400), ("the", 0, 5000), ("x", 1, 900), ("0", 50, 5), ("long", 3, 0)]
    periods, total = sum(r[1] for r in rows), sum(r[1] + r[2] for r in rows)

    def score(word, d, b):
        p, inner = periods / total, word.count(".")
        length = len(word) - inner
        ratio = 2 * (d * math.log(0.99 / p) + b * math.log(0.01 / (1 - p)))
        return ratio * math.exp(-length) * (inner + 1) * float(length) ** -b

    want = {r[0]: score(*r) for r in rows if r[1] and r[0] != "0" and score(*r) >= 0.3}
    got = {r["word"]: r["score"] for r in E.abbreviations(counts(spark, rows)).collect()}
    assert {"etc", "u.s", "mr"} <= set(got) and "end" not in got and "x" not in got
    assert got == pytest.approx(want)
    assert E.abbreviations(counts(spark, [])).collect() == []
    assert E.abbreviations(counts(spark, [("a", 5, 0)])).collect() == []  # every word has a period: nothing can be told


def planted(spark):
    """200 texts: 'approx.' and 'U.S.' inside sentences, 'market.' at their ends."""
    rows = [(k, f"the U.S. plan for approx. {k} long-term $TSLA shares moved the market. we don't sell in the market (word{k % 7}).") for k in range(200)]
    return spark.createDataFrame(rows, "id long, t string")


def test_abbreviations_found_in_texts(spark):
    chunks = K.chunk_counts(planted(spark), "t", "id")
    assert {r["word"] for r in E.abbreviations(E.period_counts(chunks)).collect()} >= {"u.s"}
    found = {r["word"]: (r["dotted"], r["bare"]) for r in E.period_counts(chunks).collect()}
    assert found["u.s"] == (200, 0) and found["market"] == (200, 200) and found["0"] == (0, 200)


def test_keywords_of_planted_texts(spark):
    got = {r["word"]: r["freq"] for r in K.keyword_counts(planted(spark), "t", "id").collect()}
    assert got["tsla"] == 200 and got["market"] == 400 and got["do"] == 200 and got["the"] == 600
    assert not {"long", "term", "u", "s", "u.s.", "long-term", "t", "n't"} & set(got)
    whole = {r["word"]: r["freq"] for r in K.keyword_counts(planted(spark), "t", "id", alpha_only=False).collect()}
    assert whole["long-term"] == 200 and whole["u.s."] == 200 and whole["n't"] == 200 and whole["$"] == 200 and whole["."] == 400


def test_a_given_table_of_abbreviations(spark):
    df = spark.createDataFrame([(1, "see fig. two and end. then go fig."), (2, "J. Smith has 5. no")], "id long, t string")
    for limit in ({}, {"max_bytes": 0}):
        table = spark.createDataFrame([("fig",), ("fig",), (None,)], "word string")
        rows = E.with_ends(K.chunk_counts(df, "t", "id"), table, **limit).collect()
        assert {(r["chunk"], r["last"]): r["ends"] for r in rows if "." in r["chunk"]} == {
            ("fig.", False): False, ("fig.", True): True, ("end.", False): True, ("j.", False): False, ("5.", False): False,
        }
        assert sum(r["n"] for r in rows) == 8 + 5
    got = {r["word"]: r["freq"] for r in K.keyword_counts(df, "t", "id", abbreviated=table).collect()}
    assert got["fig"] == 1 and got["end"] == 1 and "j" not in got


def test_a_chunk_in_most_places(spark):
    """One chunk holds nearly all rows; it is counted before it moves."""
    df = spark.range(4000).select("id", F.concat(F.repeat(F.lit("hot "), F.lit(50)), F.col("id").cast("string")).alias("t"))
    top = K.keyword_frequency(df, "t", "id", stops=(), topn=1).collect()
    assert [tuple(r) for r in top] == [("hot", 200_000)]
