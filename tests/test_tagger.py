import random

import pytest
from marketprose.operators import clean as C
from marketprose.operators import tagger as G
from pyspark.sql import functions as F


def sentences(n, seed=1):
    """The tag of a word depends on its ending, and for some on the word before."""
    r = random.Random(seed)
    for _ in range(n):
        words, tags = [], []
        for _ in range(r.randint(1, 9)):
            kind = r.choice(["DT", "NN", "VB", "RB"])
            stem = "".join(r.choice("bcdfgklm") + r.choice("aeiou") for _ in range(2))
            words.append({"DT": "the", "NN": stem + "tion", "VB": stem + "fy", "RB": stem + "ly"}[kind])
            tags.append(kind)
            if kind == "DT":  # the same form is a noun after "the", else a verb
                words.append("run")
                tags.append("NN")
            elif kind == "RB":
                words.append("run")
                tags.append("VB")
        yield words, tags


def plain(rows, rounds):
    """Averaged perceptron with every weight vector summed in full."""
    names = sorted({t for _, tags in rows for t in tags})
    weights, total, steps = {}, {}, 0
    for _ in range(rounds):
        for words, gold in rows:
            last = second = G.BEFORE
            for i, right in enumerate(gold):
                found = G.features(words, i, last, second)
                score = {t: sum(weights.get((f, t), 0.0) for f in found) for t in names}
                guess = min(names, key=lambda t: (-score[t], t))
                if guess != right:
                    for f in found:
                        weights[f, right] = weights.get((f, right), 0.0) + 1
                        weights[f, guess] = weights.get((f, guess), 0.0) - 1
                steps += 1
                for key, value in weights.items():
                    total[key] = total.get(key, 0.0) + value
                last, second = guess, last
    return {key: value / steps for key, value in total.items() if value}


def table(spark, rows):
    return spark.createDataFrame(rows, "words array<string>, tags array<string>").repartition(3)


def test_one_shard_is_the_plain_perceptron(spark):
    rows = list(sentences(40))
    model = G.fit_tagger(table(spark, rows), rounds=3)
    order = table(spark, rows).withColumn("p", F.xxhash64("words", "tags")).orderBy("p", "words", "tags").collect()
    expected = plain([(list(r.words), list(r.tags)) for r in order], 3)
    got = {(f, t): w for f, row in model.weights.items() for t, w in row.items()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in expected.items())


def test_held_out_accuracy_in_shards(spark):
    model = G.fit_tagger(table(spark, list(sentences(600))), shard_sentences=100)
    test = list(sentences(200, seed=2))
    right = sum(a == b for words, tags in test for a, b in zip(model.tag(words), tags, strict=True))
    assert right / sum(len(t) for _, t in test) > 0.97
    got = G.add_tags(table(spark, test), model, "words", "found").collect()
    assert all(r.found == model.tag(list(r.words)) for r in got)
    assert G.add_tags(table(spark, [(None, None), ([], [])]), model, "words").select("tags").distinct().count() == 2


def test_the_extension_point_takes_it(spark):
    model = G.fit_tagger(table(spark, list(sentences(300))))
    posts = spark.createDataFrame([(1, "The batution quickly gakafy! $TSLA 100m"), (2, "")], "id int, body string")
    out, _ = C.preprocess_text(posts, "body", tagger=model.udf(posts))
    assert [r.clean for r in out.orderBy("id").collect()] == ["batution $TSLA 100M", ""]


def test_bad_rows_and_none(spark):
    rows = [(["a"], ["X", "Y"]), (None, ["X"]), ([], []), (["a", None], ["X", "X"])]
    empty = G.fit_tagger(table(spark, rows))
    assert empty.tags == [] and empty.tag(["a", "b"]) == ["", ""]
    one = G.fit_tagger(table(spark, rows + [(["a"], ["X"])] * 3), max_sentences=2)
    assert one.tag(["whatever", "it"]) == ["X", "X"]
