import bisect
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from marketprose.llm import collocations as c


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def brute(rows, least, longest, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, of in counts.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, f in candidates.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    p = q[i : i + size]
                    if 100 * f >= percent * candidates[p]:
                        inside.add(p)
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, l, r = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def sample():
    r = random.Random(9)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "漢", "a\x00b", "x\x1cy", "New", "york", "city"]
    rows = []
    for k in range(300):
        text = ""
        for _ in range(r.choice([0, 1, 5, 60])):
            text += r.choice(words) + r.choice([" "] * 9 + ["  ", "\t", ". ", "\n", ",", "; new york city "])
        rows.append((r.choice(["en", "fr", None, "und"]), text))
    rows += [("en", None), (None, None), ("de", ""), ("de", " .\t. "), ("en", "the cat sat on the mat " * 200)]
    return rows + [("fr", "same words every time in one row. " * 40)] * 3


def table(spark, rows, partitions=4):
    df = spark.createDataFrame([(k, t, lg, "x", 1) for k, (lg, t) in enumerate(rows)], "f long, text string, lang string, phrase string, n int")
    return df.repartition(partitions)


@pytest.mark.parametrize("least, sizes", [(3, {}), (5, {"block_words": 300, "part_windows": 64, "chunk": 50}), (30, {"part_windows": 90, "chunk": 1000})])
def test_against_brute_force(spark, least, sizes):
    rows = sample()
    got = c.collocations(table(spark, rows), least=least, top=40, **sizes).collect()
    expected = brute(rows, least, 4, 80, 40)
    assert len(expected) > 10
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == expected


def test_other_lengths_and_no_limit(spark):
    rows = sample()
    for longest, percent in ((2, 80), (6, 50)):
        got = c.collocations(table(spark, rows), least=4, longest=longest, percent=percent, top=None, part_windows=100, chunk=64).collect()
        assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, 4, longest, percent, None)


def test_empty(spark):
    assert c.collocations(table(spark, [("en", None)])).count() == 0
    assert c.collocations(table(spark, [("en", "a b")]).limit(0)).count() == 0


def test_streams_pack_and_cut():
    rng = np.random.default_rng(3)
    numbers = c.Numbers()
    words = [b"w%d" % k for k in rng.integers(0, 40, 3000)]
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32)
    ids[::17] = 0
    stream = c.block_stream(numbers, ids, 4)
    keys = [stream.key(i) for i in range(len(stream))]
    assert keys == sorted(set(keys)) and stream.counts.sum() == (ids > 0).sum()
    stream.counts[5] = 2**40 + 3
    for lo, hi in ((0, len(stream)), (10, 11), (7, 900)):
        back = c.Stream.unpack(stream.cut(lo, hi).pack())
        assert [back.key(i) for i in range(len(back))] == keys[lo:hi]
        assert (back.counts == stream.counts[lo:hi]).all()


def test_counts_pass_64_bits(spark):
    """The score of counts near 2^60 as the query computes it."""
    f, l, r = 2**60 + 7, 2**60 + 11, 2**60 + 13
    expr = "cast(2000000 as decimal(10, 0)) * cast(f as decimal(20, 0)) div cast(l + r as decimal(20, 0)) as s"
    assert spark.createDataFrame([(f, l, r)], "f long, l long, r long").selectExpr(expr).first().s == 2_000_000 * f // (l + r)


def test_a_block_takes_little_memory(spark):
    rng = np.random.default_rng(5)
    numbers = c.Numbers()
    words = [b"w%d" % i for i in range(3_000)]
    ids = np.array([numbers[w] for w in words], np.int32)[rng.zipf(1.3, 400_000) % 3_000]
    ids[::50] = 0
    tracemalloc.start()
    stream = c.block_stream(numbers, ids, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55 * len(ids)
    windows = Counter()
    names = [b"", *words]
    for i in np.flatnonzero(ids).tolist():
        ended = False
        window = [names[w] if (ended := ended or w == 0) is False else b"" for w in ids[i : i + 4].tolist()]
        windows[tuple(window + [b""] * (4 - len(window)))] += 1
    assert [(stream.key(i), int(stream.counts[i])) for i in range(len(stream))] == sorted(windows.items())


def test_texts_come_in_small_batches(spark):
    docs = spark.range(5_000).selectExpr("'en' AS lang", "concat('one two three ', id % 7) AS text")
    grams, _ = c.count_ngrams(docs, 1, 2)
    assert grams.count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_parts_are_of_like_size(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    rows = [("en", " ".join(words[min(rng.randrange(400), rng.randrange(400))] for _ in range(800))) for _ in range(96)]
    docs = spark.sparkContext.parallelize(rows, 96).toDF("lang string, text string")
    found = c._streams(docs, "lang", "text", 3, 1 << 20, 1 << 19, 200).collect()
    streams = [c.Stream.unpack(bytes(r["packed"])) for r in found]
    keys = sorted(("en", s.key(i)) for s in streams for i in range(len(s)))
    bounds = c.bounds_of([("en", tuple(bytes(h).split(b" "))) for r in found for h in r["heads"]], -(-len(keys) // 3200))
    sizes = Counter(bisect.bisect_right(bounds, k) for k in keys)
    assert len(bounds) > 10 and max(sizes.values()) < 3 * 3200
