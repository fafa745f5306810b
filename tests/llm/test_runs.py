import random
import zlib

import numpy as np
import pytest
from marketprose.llm import runs
from marketprose.llm.queries import planted_repeat


def brute(words, least, times):
    """Every stretch of every period; only the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
    return sorted((s, m, q) for (s, m), q in found.items())


def texts():
    r = random.Random(5)
    for _ in range(300):
        words = []
        while len(words) < r.choice([5, 40, 150]):
            root = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.choice([1, 2, 3, 7, 20]))]
            words += (root * r.choice([1, 2, 3, 9]))[: r.randint(1, 80)]
        yield words
    yield list("a" * 500)
    yield [f"w{k}" for k in range(300)]
    yield list("abaababaabaababaababa" * 9)


def symbols(words):
    return np.unique(words, return_inverse=True)[1].astype(np.int64)


@pytest.mark.parametrize("least, times", [(2, 3), (6, 3), (24, 3), (10, 4)])
def test_long_runs_against_brute_force(least, times):
    for words in texts():
        assert list(map(tuple, runs.long_runs(symbols(words), least, times).tolist())) == brute(words, least, times)


def test_all_runs_have_two_periods():
    for words in texts():
        assert list(map(tuple, runs.all_runs(symbols(words)).tolist())) == brute(words, 2, 2)


def test_tree_and_ancestors():
    rng = np.random.default_rng(6)
    for size in (1, 2, 30, 200):
        for top in (1, 2, 50):
            s = rng.integers(1, top + 1, size)
            tree = runs.SuffixTree(s)
            tails = [s[i:].tolist() for i in range(size)]
            assert tree.ranks().argsort().tolist()[:] == sorted(range(size), key=lambda i: tails[i])
            flipped = [[-v for v in t] for t in tails]
            assert tree.ranks(turned=True).argsort().tolist() == sorted(range(size), key=lambda i: flipped[i])
            lca = runs.Ancestors(tree)
            pairs = [(i, j) for i in range(size) for j in range(size) if i != j][:: max(1, size * size // 400)]
            for i, j in pairs:
                common = 0
                while max(i, j) + common < size and s[i + common] == s[j + common]:
                    common += 1
                assert lca.common(np.array([i]), np.array([j])).tolist() == [common]


def test_documents(make):
    loop = "again and again so " * 30
    rows = [(1, None), (2, ""), (3, "one"), (4, loop), (4, loop), (None, loop), (2**60 + 1, "x\x0by\t" * 40 + "Z z z")]
    rows += [(2**60 + 2, "a " * 23), (2**60 + 3, "a " * 24), (7, " ".join(f"u{k}" for k in range(3000)))]
    rows.append((8, " ".join([f"v{k}" for k in range(2000)] * 4)))
    got = sorted(runs.collapse_runs(make(rows)).collect(), key=str)
    expected = []
    for doc, text in rows:
        words = (text or "").encode().split()
        found = brute(words, 24, 3)
        best = max(range(len(found)), key=lambda k: (found[k][1] / found[k][2], -k), default=None)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        expected.append((doc, len(words), found, best, kept))
    flat = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best, r.collapsed) for r in got]
    assert sorted(flat, key=str) == sorted(expected, key=str)
    assert runs.collapse_runs(make([])).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(make([]), times=2)


def test_planted_repeats(make):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["a", "b", "c", f"w{k}"]) for _ in range(r.choice([0, 3, 30, 200])))) for k in range(200)]
    got = {x.doc_id: x for x in runs.collapse_runs(make(rows), edit=planted_repeat).collect()}
    planted = 0
    for doc, text in rows:
        words, h = text.encode().split(), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(words, 24, 3)
        assert [tuple(x) for x in got[doc].runs] == found
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert got[doc].collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert planted > 5
    assert planted_repeat(None, 5) is None
