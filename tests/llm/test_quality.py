import random

import numpy as np
from marketprose.llm import quality
from marketprose.llm.common import remainder


def text(r: random.Random, good: bool) -> str:
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60))]
    return " ".join(words) if good else " ".join(w + r.choice(["%%%", "$$$"]) for w in words)


def rows(n: int, seed: int = 1):
    r = random.Random(seed)
    good = [r.random() < 0.8 for _ in range(n)]
    return [text(r, g) for g in good], np.array(good)


def test_shapes_are_worked_out_once_per_pattern_of_signs():
    r = random.Random(3)
    words = list({"".join(r.choice("abcdeinorst") for _ in range(6)).capitalize() + "," for _ in range(3000)})
    quality.forget_recent()
    quality.indicators(" ".join(words))
    assert len(words) > 2000 and len(quality._SHAPES) == 1
    signs = ["ABc--12", "Xyz-1", "É\u0301é...", "...", "\U0001d400\u00b2", "C0ba,,,"]
    same = ["QRs----9", "Ab-77", "Ha....", "..", "Z3", "M1x,,"]
    for a, b in zip(signs, same, strict=True):
        assert quality._SHAPES[a.translate(quality._SIGNS)] == quality._SHAPES[b.translate(quality._SIGNS)]


def test_held_out_accuracy():
    texts, good = rows(400)
    model = quality.fit([quality.indicators(t) for t in texts], good)
    texts, good = rows(200, seed=2)
    scores = np.array([model.score(t) for t in texts])
    assert ((scores >= 0.5) == good).mean() > 0.98
    assert scores.min() >= 0 and scores.max() <= 1
    assert 0 <= model.score("") <= 1 and 0 <= model.score("x " * 100_000) <= 1


def test_dual_descent_solves_the_hinge_loss():
    rng = np.random.default_rng(0)
    found = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    good = rng.random(60) < 0.5
    ratio = np.zeros(1 << quality.BITS, np.float32)
    ratio[:40] = rng.normal(size=40)
    weight, bias = quality.dual_descent(found, good, ratio, epochs=2000, tol=1e-8)
    x = np.zeros((60, 41))
    for i, f in enumerate(found):
        x[i, f] = ratio[f] / np.linalg.norm(ratio[f])
    x[:, 40] = 1
    y, cost = np.where(good, 1, -1), np.where(good, 30 / good.sum(), 30 / (~good).sum())

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    best = np.append(weight[:40], bias).astype(float)
    assert all(loss(best) <= loss(best + rng.normal(size=41) * s) + 1e-4 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_log_count_ratio():
    a = [np.array([1, 2], np.int32), np.array([2], np.int32)]
    ratio = quality.log_count_ratio(a, np.array([True, False]))
    assert ratio[1] > 0 > ratio[2] - ratio[1] and ratio[3] == 0


def test_one_class_and_none():
    sure = quality.fit([quality.indicators("a b")] * 3, np.array([True] * 3))
    assert abs(sure.score("anything") - 0.8) < 1e-6
    assert quality.fit([], np.array([], bool)).score("") == 0.5


def test_tables(spark, make):
    texts, good = rows(150)
    docs = make([*enumerate(texts), (None, "x"), (1000, None), (1001, ""), (1, texts[1])])
    labels = [(i, int(g)) for i, g in enumerate(good.tolist())] + [(None, 1), (3, None), (99_999, 1), (5, int(good[5]))]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("text", docs.limit(1).select("size").first()[0] and remainder("doc_id", 3))
    model = quality.fit_labelled(docs, labels, remainder("doc_id", 5) != 0)
    got = quality.score(docs, model).select("doc_id", "score").collect()
    assert len(got) == 154 and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == good[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 150]
    assert np.mean(right) > 0.95
    few = quality.fit_labelled(docs, labels, max_rows=20)
    assert 0 <= few.score("a b c") <= 1
    assert quality.score(make([]), model).count() == 0
    assert quality.fit_labelled(make([]), labels).score("") == 0.5
