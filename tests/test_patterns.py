"""Many patterns at once, against a search of every text for every pattern."""

import random

import pytest

from marketprose.operators import patterns as PT


def places(text, pattern):
    return {i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)} if text and pattern else set()


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_occurrences_equal_a_plain_search(spark, limit):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n\0") for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))) for _ in range(40)]
    long = "".join(rng.choice("abcdefgh 😀é") for _ in range(3 * PT.PIECE + 17))
    texts += [long, "a" * (PT.PIECE + 40), None, "", long[PT.PIECE - 20 : PT.PIECE + 90], "😀"]
    patterns = {"a", "ab", "aba", "bb\0a", "\0", "\0ab", "😀", "é ", "a" * 70, "a" * 33, "", "nowhere at all"}
    patterns |= {long[i : i + n] for i, n in [(0, 32), (0, 33), (5, 64), (PT.PIECE - 30, 100), (len(long) - 65, 65), (4000, 5000), (4, 3)]}
    patterns |= {long[100:140] + "?"}  # its first tile is in the text, its last is not
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(patterns))] + [(None, -1)], "pattern string, no long")
    got = sorted((r["id"], r["start"], r["pattern"], r["no"]) for r in PT.occurrences(df, "id", "t", table, "pattern", max_bytes=limit).collect())
    numbered = {p: i for i, p in enumerate(sorted(patterns))}
    assert got == sorted((k, s, p, numbered[p]) for k, t in enumerate(texts) for p in patterns for s in places(t, p))


def test_the_probe_is_the_rarest_gram(spark):
    df = spark.createDataFrame([(0, "the the the then xyz")], "id int, t string")
    table = spark.createDataFrame([("the xyz",), ("the",)], "pattern string")
    index = {r["tile"]: (r["gram"], r["offset"]) for r in PT.tile_index(df, "id", "t", table, "pattern").collect()}
    assert index == {"the xyz": (" xy", 3), "the": ("the", 0)}  # held once, and the first such gram


def test_flags_with_empty_rules_and_without_texts(spark):
    df = spark.createDataFrame([(0, "Alpha"), (1, None), (2, "")], "id int, t string")
    rules = spark.createDataFrame([(5, "any", ""), (2, "alpha", "ALPHA"), (2, "later", "lpha")], "rule_pos int, label string, keyword string")
    got = {r["id"]: r["flag_case"] for r in PT.rule_flag_table(df, "id", "t", rules).collect()}
    assert got == {0: "alpha", 1: None, 2: "any"}
    assert PT.rule_flag_table(df.limit(0), "id", "t", rules).collect() == []


def test_the_text_is_in_no_join_and_no_shuffle(spark):
    df = spark.createDataFrame([(0, "some alpha text")], "id int, t string")
    rules = spark.createDataFrame([(2, "alpha", "alpha")], "rule_pos int, label string, keyword string")
    plan = PT.rule_flag_table(df, "id", "t", rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join Inner" in plan  # only the windows and the index meet
