"""Term weights, factors, topics, sentiment and word clouds against independent calculations."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketprose.operators import keywords as K
from marketprose.operators import lda as LD
from marketprose.operators import nmf as NM
from marketprose.operators import sentiment as S
from marketprose.operators import topics as TP
from marketprose.operators import vectorize as V
from marketprose.plans.posts import post_topics

WORDS = "rocket launch orbit car battery factory model profit market stock moon engine".split()


def corpus(n=50, seed=4):
    rng = random.Random(seed)
    themes = [WORDS[:4], WORDS[4:8], WORDS[8:]]
    texts = []
    for i in range(n):
        theme = themes[i % 3]
        texts.append(" ".join(rng.choice(theme if rng.random() < 0.85 else WORDS) for _ in range(rng.randint(3, 25))))
    return texts + ["", "$ROCKET 100M a"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(corpus())), "id int, clean string").cache()


def dense_tfidf(texts, low=1, high=3, min_df=2, max_df=0.85):
    bags = []
    for t in texts:
        words = re.findall(r"(?u)\b\w\w+\b", t.lower())
        bags.append(Counter(" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)))
    df = Counter(w for b in bags for w in b)
    vocab = sorted(w for w, c in df.items() if min_df <= c <= max_df * len(texts))
    x = np.array([[b[w] * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w in vocab] for b in bags])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), vocab


def as_dense(cells, vocab, n, value):
    out = np.zeros((n, len(vocab)))
    index = {w: j for j, w in enumerate(vocab)}
    for r in cells.collect():
        out[r["id"], index[r["term"]]] = r[value]
    return out


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_tfidf_matches_a_dense_calculation(docs, limit):
    x, vocab = dense_tfidf(corpus())
    cells, terms = V.tfidf(docs, "clean", "id", min_df=2, max_bytes=limit)
    assert sorted(r["term"] for r in terms.collect()) == vocab
    np.testing.assert_allclose(as_dense(cells, vocab, len(x), "tfidf"), x, atol=1e-12)
    assert {round(r[0], 9) for r in cells.groupBy("id").agg(F.sum(F.col("tfidf") ** 2)).select("sum(POWER(tfidf, 2))").collect()} == {1.0}


def test_tfidf_moves_texts_once(docs):
    cells, _ = V.tfidf(docs, "clean", "id", min_df=2)
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_count_matrix(spark):
    texts = ["aa bb aa s", "aa Bb été_x é1 bb_2", "aa 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    cells, vocab = V.count_matrix(df, "t", "id", min_df=1, max_df=1.0)
    assert {(r["id"], r["term"]): r["tf"] for r in cells.collect()} == {
        (0, "aa"): 2, (0, "bb"): 1, (1, "aa"): 1, (1, "bb_2"): 1, (2, "aa"): 1, (2, "12"): 1,
    }
    assert {r["term"]: (r["df"], r["n"]) for r in vocab.collect()}["aa"] == (3, 3)


def test_svd_matches_numpy(docs):
    x, vocab = dense_tfidf(corpus())
    cells = V.tfidf(docs, "clean", "id", min_df=2)[0]
    factors = NM.Cells(cells, "id", "term", "tfidf")
    u, s, v = NM.truncated_svd(factors, 4)
    want = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(s, want[1][:4], rtol=1e-4)
    rows = {r["id"]: r["weights"] for r in u.collect()}
    got_u = np.array([rows.get(i, [0.0] * 4) for i in range(len(x))])
    cols = {r["term"]: r["weights"] for r in factors.named(v).collect()}
    got_v = np.array([cols[w] for w in vocab])
    np.testing.assert_allclose(got_u * s @ got_v.T, (want[0][:, :4] * want[1][:4]) @ want[2][:4], atol=0.05)


def hals_sweep(m, gram, product):
    m = m.copy()
    moved = 0.0
    for t in range(m.shape[1]):
        grad = m @ gram[t] - product[:, t]
        moved += np.abs(np.where(m[:, t] == 0, np.minimum(grad, 0), grad)).sum()
        if gram[t, t] > 0:
            m[:, t] = np.maximum(m[:, t] - grad / gram[t, t], 0)
    return m, moved


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_nmf_matches_dense_coordinate_descent(docs, limit):
    x, vocab = dense_tfidf(corpus())
    cells = V.tfidf(docs, "clean", "id", min_df=2)[0].cache()
    source = NM.Cells(cells, "id", "term", "tfidf", limit)
    w0, h0 = NM.uniform_start(source, 3)
    w = np.zeros((len(x), 3))
    for r in w0.collect():
        w[r["id"]] = r["weights"]
    h = np.array([r["weights"] for r in sorted(source.named(h0).collect(), key=lambda r: r["term"])])
    losses, violations = [], []
    for _ in range(4):
        w, a = hals_sweep(w, h.T @ h, x @ h)
        h, b = hals_sweep(h, w.T @ w, x.T @ w)
        losses.append(np.linalg.norm(x - w @ h.T))
        violations.append(a + b)
    fit = NM.fit_nmf(cells, "id", topics=3, max_iter=4, init="random", max_bytes=limit)
    got_h = np.array([r["weights"] for r in sorted(fit.term_factors.collect(), key=lambda r: r["term"])])
    got_w = np.zeros_like(w)
    for r in fit.doc_factors.collect():
        got_w[r["id"]] = r["weights"]
    np.testing.assert_allclose(got_h, h, atol=1e-9)
    np.testing.assert_allclose(got_w, w, atol=1e-9)
    np.testing.assert_allclose(fit.violations, violations, rtol=1e-9)
    assert all(b <= a + 1e-12 for a, b in pairwise(losses)) and got_w.min() >= 0 and got_h.min() >= 0


def test_nmf_stops_and_separates_themes(docs):
    out = post_topics(docs.withColumnRenamed("clean", "text"), "id", topics=3, min_df=2, max_iter=60, min_tokens=1, use_pos=False)
    assert out.iterations <= 60
    terms = defaultdict(list)
    for r in out.terms.orderBy("topic", "rank").collect():
        terms[r["topic"]].append((r["weight"], r["term"]))
    assert len(terms) == 3 and all(t == sorted(t, key=lambda p: -p[0]) for t in terms.values())
    themes = [set(WORDS[:4]), set(WORDS[4:8]), set(WORDS[8:])]
    assert sorted(next(i for i, th in enumerate(themes) if t[0][1].split()[0] in th) for t in terms.values()) == [0, 1, 2]
    assert out.counts.agg(F.sum("n")).first()[0] == out.posts.count()


def test_no_terms_left(docs):
    cells, vocab = V.tfidf(docs, "clean", "id", min_df=1000)
    assert vocab.count() == cells.count() == 0
    with pytest.raises(ValueError):
        NM.fit_nmf(cells, "id")


def test_attach_topic_without_weights(spark):
    posts = spark.createDataFrame([(1,), (2,)], "id int")
    factors = spark.createDataFrame([(1, [0.1, 0.9])], "id int, weights array<double>")
    rows = {r["id"]: (r["topic_id"], r["topic_score"]) for r in TP.attach_topic(posts, factors, "id", 2).collect()}
    assert rows == {1: (1, 0.9), 2: (0, 0.0)}


def test_topic_tables(spark):
    terms = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0), (1, "a", 0.5)], "topic int, term string, weight double")
    assert [(r["topic"], r["term"]) for r in TP.topics_table(terms, 2).orderBy("topic", "rank").collect()] == [(0, "c"), (0, "a"), (1, "a")]
    assert {r["topic"]: r["top_terms"] for r in TP.topic_summary(terms, 3).collect()} == {0: "c, a, b", 1: "a"}
    wide = TP.doc_topic_wide(spark.createDataFrame([("x", [0.2, 0.8])], "link string, weights array<double>"), 2, ["link"]).first()
    assert tuple(wide) == ("x", 0.2, 0.8, "topic_1", 0.8)


def dense_lda(x, start, steps, prior):
    """Batch variational Bayes on a dense matrix, documents without words left out."""
    lam = start.copy()
    for step in range(steps + 1):
        beta = np.exp(LD.digamma(lam) - LD.digamma(lam.sum(0)))
        gammas, stats = np.zeros((len(x), lam.shape[1])), np.zeros_like(lam)
        for d, row in enumerate(x):
            gamma = np.ones(lam.shape[1])
            for _ in range(LD.INNER_ROUNDS):
                before = gamma
                theta = np.exp(LD.digamma(gamma) - LD.digamma(gamma.sum()))
                gamma = prior + theta * ((row / (beta @ theta + 1e-100)) @ beta)
                if np.abs(gamma - before).mean() < LD.INNER_TOL:
                    break
            theta = np.exp(LD.digamma(gamma) - LD.digamma(gamma.sum()))
            stats += beta * np.outer(row / (beta @ theta + 1e-100), theta)
            gammas[d] = gamma / gamma.sum()
        if step == steps:
            return lam, gammas
        lam = prior + stats


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_lda_matches_dense_updates(docs, limit):
    counts, _ = V.count_matrix(docs, "clean", "id", min_df=2)
    counts = counts.cache()
    cells = LD.Cells(counts, "id", "term", "tf", limit)
    fit = LD.Topics(cells, 3, 42)
    start = {r["term"]: r["weights"] for r in cells.named(fit.rows).collect()}
    names = sorted(start)
    ids = sorted(r["id"] for r in counts.select("id").distinct().collect())
    x = np.zeros((len(ids), len(names)))
    for r in counts.collect():
        x[ids.index(r["id"]), names.index(r["term"])] = r["tf"]
    lam, gammas = dense_lda(x, np.array([start[t] for t in names]), 4, 1 / 3)
    for _ in range(4):
        fit.step()
    got = {r["term"]: r["weights"] for r in cells.named(fit.rows).collect()}
    np.testing.assert_allclose([got[t] for t in names], lam, atol=1e-6)
    mixed = {r["id"]: r["weights"] for r in fit.documents().collect()}
    np.testing.assert_allclose([mixed[i] for i in ids], gammas, atol=1e-6)


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 3.0, 50.0])
    np.testing.assert_allclose(LD.digamma(x), [-100.5608854579, -1.9635100260, -0.5772156649, 0.9227843351, 3.9019896735], atol=1e-9)


def test_lda_rows_are_distributions_and_repeat(docs):
    empty = docs.union(docs.limit(1).select(*[F.lit(None).alias(c) if c != "id" else F.lit(-1).alias("id") for c in docs.columns]))
    fit = LD.fit_lda(empty, "clean", "id", topics=3, max_iter=8, min_df=2)
    rows = {r["id"]: np.array(r["weights"]) for r in fit.doc_topics.collect()}
    assert len(rows) == empty.count() and all(abs(w.sum() - 1) < 1e-9 and w.min() >= 0 for w in rows.values())
    np.testing.assert_allclose(rows[-1], [1 / 3] * 3)
    again = LD.fit_lda(empty, "clean", "id", topics=3, max_iter=8, min_df=2)
    for r in again.doc_topics.collect():
        np.testing.assert_allclose(r["weights"], rows[r["id"]], rtol=1e-6)
    with pytest.raises(ValueError):
        LD.fit_lda(docs, "clean", "id", min_df=1000)


# ---- sentiment -----------------------------------------------------------------


@pytest.mark.parametrize(
    "text, score",
    [
        ("The book was good.", 0.4404),
        ("The book was kind of good.", 0.3832),
        ("At least it isn't a horrible book.", 0.431),
        ("not good", -0.3412),
        ("The plot was good, but the characters are worse.", -0.3291),
        ("", 0.0),
        (None, 0.0),
        ("plain words", 0.0),
    ],
)
def test_compound_score(spark, text, score):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(S.compound_score(F.col("t"))).first()[0]
    if text and "plot" in text:
        halves = 1.9 * 0.5 - 2.1 * 1.5
        score = round(halves / math.sqrt(halves**2 + 15), 4)
    assert got == score


def scored(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(S.compound_score(F.col("t"))).first()[0]


def normal(total):
    return round(total / math.sqrt(total * total + 15), 4)


def test_sentiment_rules(spark):
    assert scored(spark, "so GOOD today") == normal(1.9 + 0.733 + 0.293)
    assert scored(spark, "VERY good today") == normal(1.9 + 0.293 + 0.733)
    assert scored(spark, "GOOD GREAT") == normal(1.9 + 3.1)
    assert scored(spark, "good!!! ok") == normal(1.9 + 3 * 0.292)
    assert scored(spark, "good??? ok") == normal(1.9 + 3 * 0.18)
    assert scored(spark, "bad !!!!!!") == normal(-(2.5 + 4 * 0.292))
    assert scored(spark, "barely good") == normal(1.9 - 0.293)
    assert scored(spark, "very much too good") == normal(1.9 + 0.293 * 0.9)
    assert scored(spark, "least good") == normal(1.9 * -0.74)
    assert scored(spark, "at least good") == normal(1.9)
    assert scored(spark, "one kind of idea") == 0.0
    assert scored(spark, "she is a kind person") == normal(2.4)
    # a repeated word takes the surroundings of its first occurrence
    assert scored(spark, "not good and truly good") == normal(2 * 1.9 * -0.74)
    assert scored(spark, "it was a bad ass ride") == normal(-2.5)


def test_sentiment_label(spark):
    df = spark.createDataFrame([("good",), ("bad",), (None,)], "content string")
    assert [r["sentiment_label"] for r in S.add_sentiment(df).collect()] == ["Positive", "Negative", "Neutral"]
    assert S.add_sentiment(df, table={"bad": 1.0}).collect()[1]["sentiment_label"] == "Positive"


# ---- keywords and clouds -------------------------------------------------------


def test_keyword_ties_keep_first_appearance(spark):
    df = spark.createDataFrame([(2, "zeta beta"), (1, "Beta alpha 42 the zeta"), (3, None)], "id int, t string")
    rows = K.keyword_frequency(df, "t", "id", stops=("the",), topn=3).collect()
    assert [tuple(r) for r in rows] == [("beta", 2), ("zeta", 2), ("alpha", 1)]
    assert K.keyword_frequency(df.filter("false"), "t", "id").collect() == []
    kept = K.keyword_frequency(df, "t", "id", stops=(), lowercase=False, alpha_only=False, topn=9)
    assert {r["word"] for r in kept.collect()} == {"zeta", "beta", "Beta", "alpha", "42", "the"}
    text_ids = df.withColumn("id", F.col("id").cast("string"))
    assert [tuple(r) for r in K.keyword_frequency(text_ids, "t", "id", stops=("the",), topn=3).collect()] == [tuple(r) for r in rows]


def plain_cloud(texts, stops):
    """Word-cloud counts one token at a time; pairs stay inside a text."""

    def fold(tokens):
        cases = defaultdict(dict)
        for w in tokens:
            cases[w.lower()][w] = cases[w.lower()].get(w, 0) + 1
        standard = {}
        plural = {k: k[:-1] for k in cases if k.endswith("s") and not k.endswith("ss") and k[:-1] in cases}
        for k, one in plural.items():
            for w, c in cases.pop(k).items():
                cases[one][w[:-1]] = cases[one].get(w[:-1], 0) + c
        counts = {}
        for k, c in cases.items():
            standard[k] = max(c.items(), key=lambda i: i[1])[0]
            counts[standard[k]] = sum(c.values())
        return counts, standard | {k: standard[o] for k, o in plural.items()}

    singles, doubles = [], []
    for t in texts:
        words = [w[:-2] if w.lower().endswith("'s") else w for w in re.findall(r"\w[\w']*", t)]
        words = [w for w in words if not w.isdigit()]
        singles += [w for w in words if w.lower() not in stops]
        doubles += [f"{a} {b}" for a, b in pairwise(words) if a.lower() not in stops and b.lower() not in stops]
    counts, standard = fold(singles)
    pairs, _ = fold(doubles)
    n, base = len(singles), dict(counts)

    def part(k, m, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (m - k)

    for pair, c12 in pairs.items():
        a, b = (standard[w.lower()] for w in pair.split(" "))
        c1, c2 = base[a], base[b]
        if n <= c1 or n <= c2:
            continue
        p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
        score = -2 * (part(c12, c1, p) + part(c2 - c12, n - c1, p) - part(c12, c1, p1) - part(c2 - c12, n - c1, p2))
        if score > 30:
            counts[a] -= c12
            counts[b] -= c12
            counts[pair] = c12
    return {w: c for w, c in counts.items() if c > 0}


def test_cloud_counts_match_a_plain_loop(spark):
    rng = random.Random(9)
    pool = "Falcon heavy rocket rockets Rocket ROCKETS engine's engine glass class classes the of 42 bus car's Cars car x".split()
    texts = []
    for _ in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            words += ["Falcon", "Heavy"]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["term"]: r["freq"] for r in K.cloud_counts(df, "t", "id", stops=("the", "of")).collect()}
    want = plain_cloud(texts, {"the", "of"})
    assert got == want and "Falcon Heavy" in got
    top = K.cloud_weights(df, "t", "id", max_words=3, stops=("the", "of")).collect()
    assert len(top) == 3 and max(r["weight"] for r in top) == 1.0
    single = K.cloud_counts(df, "t", "id", stops=("the", "of"), collocations=False, normalize_plurals=False).collect()
    assert {r["term"].lower() for r in single} >= {"rocket", "rockets"}
