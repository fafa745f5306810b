"""Cleaning, tokens and word functions on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from marketprose.functions import dates as D
from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.operators import clean as C
from marketprose.operators import patterns as PT
from marketprose.operators import select as S
from marketprose.operators import tokens as T
from marketprose.operators import stopwords as SW


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_basic_cleanup(spark):
    got = values(
        spark,
        ["RT @User_1: See https://t.co/x NOW!! $TSLA up 5%", "  a b\t\nc ", "", "don't", "été_2 — naïve", "漢字 word 🚀🚀"],
        X.basic_cleanup,
    )
    assert got == ["rt see now $tsla up 5", "a b c", "", "don t", "été_2 naïve", "word"]


def test_keep_cjk(spark):
    assert values(spark, ["漢字 ok 🚀"], lambda t: X.basic_cleanup(t, keep_cjk=True)) == ["漢字 ok"]


def test_clean_simple_codes_stops_and_lemmas(spark):
    got = values(spark, ["Media on MARS: $TSLA 100m 5% cars, buses, companies, glass, don't go"], C.clean_simple)
    assert got == ["medium mar $TSLA 100M car bus company glass"]


def test_clean_nouns_keeps_nouns_and_codes(spark):
    assert values(spark, ["quickly running amazing rockets $tsla 42", ""], C.clean_nouns) == ["rocket $TSLA", ""]


def test_clean_with_own_tagger(spark):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def tagger(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: ["NNS" if t.endswith("s") else "VB" for t in ts])

    df = spark.createDataFrame([("rockets fly over $tsla",)], "content string")
    out, column = C.preprocess_text(df, tagger=tagger)
    assert (column, out.first()["clean"]) == ("content", "rocket $TSLA")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_clean_by_tables(spark, limit):
    rows = [(1, "The media sees rockets, 100m $tsla seen"), (2, "the of"), (3, None), (4, "rockets rockets")]
    df = spark.createDataFrame(rows, "id int, t string")
    stops = spark.createDataFrame([("the",), ("of",), ("the",)], "word string")
    lemmas = spark.createDataFrame([("media", "medium"), ("rockets", "rocket"), ("seen", "see")], "word string, lemma string")
    pos = spark.createDataFrame([("media", "NNS"), ("rockets", "NNS"), ("seen", "VBN")], "word string, pos string")
    clean = lambda **k: {r["id"]: r["clean"] for r in C.clean_by_tables(df, "id", "t", stops, lemmas, max_bytes=limit, **k).collect()}
    assert clean() == {1: "medium sees rocket 100M $TSLA see", 2: "", 3: "", 4: "rocket rocket"}
    assert clean(pos=pos) == {1: "medium rocket 100M $TSLA", 2: "", 3: "", 4: "rocket rocket"}


def test_detect_text_column(spark):
    df = spark.createDataFrame([("a", "b")], "text string, body string")
    assert S.detect_text_column(df) == "text"
    with pytest.raises(ValueError):
        S.detect_text_column(df, ("content",))


def test_min_tokens_and_null_text(spark):
    df = spark.createDataFrame([("rocket engine test",), ("rocket",), (None,), ("  ",)], "text string")
    out, _ = C.preprocess_text(df, "text", min_tokens=3, use_pos=False)
    assert [r["clean"] for r in out.collect()] == ["rocket engine test"]
    assert C.preprocess_text(df, "text", min_tokens=0)[0].count() == 4


def test_cleaning_runs_once_per_row(spark):
    df = spark.createDataFrame([("rocket engine test",)], "text string")
    out, _ = C.preprocess_text(df, "text", min_tokens=3, use_pos=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_word_count_is_unicode(spark):
    assert values(spark, ["é éa x_1 $5", None, ""], lambda t: X.word_run_count(X.to_text(t))) == [4, 0, 0]


def test_predicates(spark):
    words = ["éa", "a1", "12", "½", "$tsla", "100m", "5%", "漢", "https://x.y/z", "tesla.com", "a.b@c.org"]
    assert values(spark, words, X.is_alpha) == [True, False, False, False, False, False, False, True, False, False, False]
    assert values(spark, words, X.is_numeric) == [False, False, True, True] + [False] * 7
    assert values(spark, words, X.is_code) == [False, False, True, False, True, True, True] + [False] * 4
    assert values(spark, words, lambda w: X.is_url_like(w) | X.is_email_like(w)) == [False] * 8 + [True] * 3


@pytest.mark.parametrize(
    "word, lemma",
    [("media", "medium"), ("mars", "mar"), ("companies", "company"), ("classes", "class"), ("houses", "house"),
     ("boxes", "box"), ("bus", "bus"), ("analysis", "analysis"), ("car", "car"), ("children", "child"), ("ties", "tie")],
)
def test_noun_lemma(spark, word, lemma):
    assert values(spark, [word], lambda w: L.noun_lemma(w)) == [lemma]


def test_own_tables(spark):
    assert values(spark, ["foo", "cars"], lambda w: L.noun_lemma(w, {"foo": "bar"})) == ["bar", "car"]
    assert values(spark, ["zoom", "x"], lambda w: L.pos_tag(w, {"VERB": ["zoom"]})) == ["VERB", "NOUN"]
    long = {f"w{i}": f"v{i}" for i in range(20_500)}
    assert values(spark, ["w20400", "cars"], lambda w: L.noun_lemma(w, long)) == ["v20400", "car"]


def test_ngrams_shorter_than_n(spark):
    split = lambda t: X.split_tokens(t)
    assert values(spark, ["a b c", "a", ""], lambda t: X.ngrams(split(t), 2)) == [["a_b", "b_c"], [], []]
    assert values(spark, ["a b c", "a b"], lambda t: X.ngrams(split(t), 3)) == [["a_b_c"], []]
    assert values(spark, ["a b c"], lambda t: X.ngram_range(split(t), 1, 3)) == [["a", "b", "c", "a b", "b c", "a b c"]]


def test_chained_ngrams_run_over_tokens_and_bigrams(spark):
    plain = values(spark, ["a b c"], lambda t: T.with_ngrams(X.split_tokens(t)))[0]
    chained = values(spark, ["a b c"], lambda t: T.with_ngrams(X.split_tokens(t), chained=True))[0]
    assert plain == ["a", "b", "c", "a_b", "b_c", "a_b_c"]
    assert chained == ["a", "b", "c", "a_b", "b_c", "a_b_c", "b_c_a_b", "c_a_b_b_c"]
    assert values(spark, ["a b"], lambda t: T.with_ngrams(X.split_tokens(t), bigrams=False, trigrams=False)) == [["a", "b"]]


def test_tokens_of_the_example_sentences(spark):
    df = spark.createDataFrame(
        [
            (1, "  Elon Musk's Tesla cars are amazing! Visit https://tesla.com  "),
            (2, "ELON\n musk bought SpaceX. Don't mail a.b@mail.org, 3.5 or 100 — tesla's"),
            (3, None),
            (4, " \n "),
        ],
        "id int, content string",
    )
    rows = {r["id"]: r for r in T.tokenize_articles(df).collect()}
    assert rows[1]["tokens"] == ["elon_musk", "tesla", "car", "amazing", "visit", "https://tesla.com"]
    assert rows[1]["tokens_nouns"] == ["elon_musk", "tesla", "car"]
    assert rows[2]["tokens"] == ["elon_musk", "buy", "spacex", "mail", "a.b@mail.org", "3.5", "tesla"]
    assert "a.b@mail.org" not in rows[2]["tokens_nouns"]
    assert rows[3]["tokens"] == [] and rows[4]["clean_text"] == ""


def test_stop_words_keep_protected_terms():
    stops = set(SW.token_stops())
    assert {"m", "amp", "rt", "we"} <= stops
    assert not stops & {"elon", "musk", "tesla", "spacex", "elon musk"}


def test_protected_stop_table(spark):
    base = spark.createDataFrame([("the",), ("elon",), ("musk",), ("the",)], "word string")
    phrases = spark.createDataFrame([("elon musk",)], "phrase string")
    assert [r[0] for r in SW.protect_stopwords(base, phrases).collect()] == ["the"]


def test_human_dates(spark):
    got = values(spark, ["Sep 05, 2025", "September 5, 2025", "soon", "", None], D.human_date_to_iso)
    assert got == ["2025-09-05", "2025-09-05", "soon", "", ""]


def test_rule_flag(spark):
    texts = ["Every seventh", "NASA and Tesla", "a rocket", "plain", None, "an EV!"]
    assert values(spark, texts, S.rule_flag) == [
        "Tesla/Electric Car", "Tesla/Electric Car", "SpaceX/NASA", None, None, "Tesla/Electric Car",
    ]
    word = lambda t: S.rule_flag(t, match="word")
    assert values(spark, texts, word) == [None, "Tesla/Electric Car", "SpaceX/NASA", None, None, "Tesla/Electric Car"]


def test_rule_flag_table(spark):
    texts = [(0, "Every seventh"), (1, "nothing here"), (2, None), (3, ""), (4, "xx KEY-00042! key-777"), (5, "it\nspans"), (6, "ev"), (7, "Every seventh")]
    df = spark.createDataFrame(texts, "id int, t string")
    rules = [(2, "late", "every"), (1, "first", "SEVEN"), (9, "short", "ev"), (3, "lines", "it\nspans"), (4, None, None)]
    rules += [(100 + k, f"r{k}", f"key-{k:05d}") for k in range(50_000)]
    table = spark.createDataFrame(rules, "rule_pos int, label string, keyword string")
    for limit in (1 << 26, 0):
        got = {r["id"]: r["flag_case"] for r in PT.rule_flag_table(df, "id", "t", table, max_bytes=limit).collect()}
        assert got == {0: "first", 1: None, 2: None, 3: None, 4: "r42", 5: "lines", 6: "short", 7: "first"}
    none = PT.rule_flag_table(df, "id", "t", table.limit(0)).collect()
    assert len(none) == len(texts) and all(r["flag_case"] is None for r in none)


def test_split_borders(spark):
    days = ["2011-11-30", "2011-12-01", "2023-12-31", "2024-01-01", "2024-04-14", "2024-04-15", "2025-04-14", "2025-04-15", None]
    got = values(spark, days, lambda d: S.split_label(d.cast("date")))
    assert got == ["exclude", "train", "train", "val", "val", "test", "test", "exclude", "exclude"]


def test_keep_pos(spark):
    assert values(spark, ["tesla quickly builds the amazing car and she", None], C.keep_pos) == [
        "tesla builds amazing car she", None,
    ]
    marks = 'The , cars . - ... the, (of) "and" fast; U.S. 3.5'
    assert values(spark, [marks, "", " , . "], C.keep_pos) == ["cars fast U.S.", "", ""]


def test_words_beside_marks_and_spaces(spark):
    marks = "a.b@mail.org x@y http://h www.a.b/c. 3.5 U.S. é.com -a@b.de it's can't… a+b@c.io _x:y 12 \u00b2 日本. \u00a0 x  \ty\n"
    texts = [marks, f" {marks} ", marks.replace(" ", "\u3000"), "a", "", "\x1c.\x85!", "https://a,b.c a_b-c.org tesla.com,x", None]
    plain = lambda pattern: values(spark, texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    assert values(spark, texts, T.raw_tokens) == plain(T.TOKEN_PATTERN)
    assert values(spark, texts, X.word_tokens) == plain(X.WORD_TOKENS)
    odd = [*texts, "A @me, HTTP://X.y\u3000z 漢字 $TSLA 5% \U0001f680b www.q ²m 100m", "   ", " a  b\t"]
    assert values(spark, odd, X.cleanup_tokens) == values(spark, odd, lambda t: X.split_tokens(X.basic_cleanup(t)))
    assert values(spark, odd, X.collapse_whitespace) == values(
        spark, odd, lambda t: F.trim(F.regexp_replace(t, f"[{X.SPACE}]+", " "))
    )
    assert values(spark, odd, X.strip_text) == values(
        spark, odd, lambda t: F.regexp_replace(t, rf"^[{X.SPACE}]+|[{X.SPACE}]+\z", "")
    )


def test_words_are_put_in_lower_case_once(spark):
    df = spark.createDataFrame([(1, "Cars")], "doc_id int, content string")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    # once per word, once for the phrases
    assert plan(T.tokenize_articles(df, phrases=[], nouns=False)).lower().count("lower(") <= 2
    assert plan(df.select(C.keep_pos(F.col("content")))).lower().count("lower(") <= 2
    few = T.tokenize_articles(df, words=False)
    assert few.columns == ["doc_id", "content", "tokens_nouns", "clean_text_nouns"]
