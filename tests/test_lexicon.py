import time

import pytest
from marketprose.functions import words as W
from marketprose.operators import clean as C
from marketprose.operators import sentiment as V
from marketprose.operators import tokens as T
from marketprose.operators.lexicon import look_up
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(f"w{i}", "VERB" if i % 2 else "NOUN", f"n{i}", f"v{i}", None if i % 3 else float(i % 5 - 2)) for i in range(25_000)]
    rows += [("w1", "ZZZ", "z", "z", 9.0), (None, "NOUN", "x", "x", 1.0)]
    return spark.createDataFrame(rows, "word string, pos string, noun string, verb string, valence double")


@pytest.mark.parametrize("join", [{}, {"max_bytes": 0}, {"max_bytes": 0, "hot_rows": 2}])
def test_look_up(spark, lexicon, join):
    rows = [(1, ["w3", "no", "w3", "w24999"]), (2, []), (3, None), (4, ["no"]), (5, ["w1"] * 50)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = {r.k: r._found for r in look_up(df, "k", F.col("t"), lexicon.select("word", "pos"), **join).collect()}
    plain = {k: v if v is None else [x and x.pos for x in v] for k, v in got.items()}
    assert plain == {1: ["VERB", None, "VERB", "VERB"], 2: [], 3: None, 4: [None], 5: ["VERB"] * 50}


def test_a_table_longer_than_memory_is_cut_to_the_words_of_the_texts(spark, lexicon, monkeypatch):
    from marketprose.operators import lexicon as module

    df = spark.createDataFrame([(1, ["w3", "w2", "x"])], "k int, t array<string>")
    monkeypatch.setattr(module, "fits_broadcast", lambda table: False)
    got = look_up(df, "k", F.col("t"), lexicon.select("word", "noun")).first()._found
    assert [x and x.noun for x in got] == ["n3", "n2", None]


def test_operators_take_tables(spark, lexicon):
    text = "w10 w11 cars the w12! W13 running. W14 boxes"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, content string")
    nouns = C.clean_nouns_by_lexicon(df, "doc_id", F.coalesce("content", F.lit("")), lexicon)
    assert [r.clean for r in nouns.orderBy("doc_id").collect()] == ["n10 car n12 n14 box", "", ""]
    lemmas = C.lemmatize_by_lexicon(df, "doc_id", F.split("content", " "), lexicon)
    assert lemmas.filter("doc_id = 1").first().lemmas == ["n10", "n11", "car", "the", "w12!", "W13", "running.", "W14", "box"]
    kept = C.keep_pos_by_lexicon(df, "doc_id", F.col("content"), lexicon, kept=("NOUN",))
    assert [r.kept for r in kept.orderBy("doc_id").collect()] == ["w10 cars the w12 W14 boxes", None, ""]
    tokens = T.tokenize_articles(df, lexicon=lexicon).orderBy("doc_id").collect()
    assert tokens[0].tokens == ["n10", "v11", "car", "n12", "v13", "runn", "n14", "box"]
    assert tokens[0].tokens_nouns == ["n10", "car", "n12", "n14", "box"] and tokens[1].tokens == tokens[2].tokens == []


def test_sentiment_tables_agree_with_lists(spark):
    texts = ["GOOD good but not very good!", "the least bad, kind of great", None, "", "never so good; GREAT great!!", "good " * 40 + "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    table = spark.createDataFrame(list(W.VALENCE.items()), "word string, valence double")
    scores = lambda table: [r.compound_score for r in V.add_sentiment(df, table=table).orderBy("doc_id").collect()]
    assert scores(table) == scores(None) and len(set(scores(None))) > 3


def test_sentiment_of_a_long_document_is_not_quadratic(spark):
    def seconds(n):
        text = " ".join(["good", "bad", "plain", "GOOD", f"w{n}"][k % 5] + ("" if k % 7 else str(k)) for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, content string").repartition(1)
        start = time.perf_counter()
        V.add_sentiment(df).collect()
        return time.perf_counter() - start

    seconds(100)
    small, large = min(seconds(5_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large < 20 * max(small, 0.3)


def test_blocks_find_what_a_broadcast_finds(spark, lexicon, monkeypatch):
    from marketprose.operators import lexicon as module

    rows = [(k, [f"w{(k * 7 + i * i) % 300}" if i % 3 else "no" for i in range(k % 40)]) for k in range(600)]
    rows += [(None, ["w1"]), (1000, None), (1001, ["w2 w3", "w2", None, ""]), (1002, [""]), (1003, []), (5, ["w2", "w9"])]
    df = spark.createDataFrame(rows, "k int, _t array<string>").repartition(3)
    found = lambda **join: sorted(map(repr, look_up(df, "k", F.col("_t"), lexicon, only=["noun"], **join).collect()))
    plain = found()
    monkeypatch.setattr(module, "BLOCK_WORDS", 90)
    assert found(max_bytes=0) == plain
    monkeypatch.setattr(module, "MAX_BLOCKS", 2)
    assert found(max_bytes=0) == plain


def test_a_word_goes_once_to_each_block_that_has_it(spark):
    from marketprose.operators.lexicon import _listed

    rows = spark.range(70_000).selectExpr("cast(id % 130 AS int) AS _block", "concat('w', id % 3 + id % 130 div 65 * 2) AS _word")
    one = spark.createDataFrame([("w0", 1), ("w2", 2), ("w9", 3)], "_word string, v int").selectExpr("_word", "struct(v) AS _v")
    got = _listed(rows, one, 130).select("_block", "_word").collect()
    wanted = rows.filter("_word IN ('w0', 'w2')").distinct().collect()
    assert sorted((r._block, r._word) for r in got) == sorted((r._block, r._word) for r in wanted)


def test_only_what_is_read_is_stored(spark, lexicon, monkeypatch):
    from marketprose.operators import lexicon as module

    stored = []
    monkeypatch.setattr(module, "written", lambda df, *a, f=module.written, **b: stored.append(df.columns) or f(df, *a, **b))
    df = spark.createDataFrame([(1, "t", "w10 w11. W12!"), (2, "u", None)], "doc_id int, title string, content string")
    kept = C.keep_pos_by_lexicon(df, "doc_id", F.col("content"), lexicon, kept=("NOUN",), keep=["doc_id"], max_bytes=0)
    assert {r.doc_id: r.kept for r in kept.collect()} == {1: "w10 W12", 2: None} and kept.columns == ["doc_id", "kept"]
    tokens = T.tokenize_articles(df, lexicon=lexicon, keep=["doc_id", "title"], words=False, max_bytes=0)
    assert {(r.doc_id, r.title): r.clean_text_nouns for r in tokens.collect()}[1, "t"].split() == ["n10", "n12"]
    scored = V.add_sentiment(df, table=lexicon, keep=["doc_id"], max_bytes=0)
    assert scored.columns == ["doc_id", "compound_score", "sentiment_label"] and scored.count() == 2
    assert not any("content" in columns for columns in stored)
