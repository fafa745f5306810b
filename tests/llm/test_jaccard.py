import random
from collections import Counter, defaultdict

from marketprose.llm import jaccard


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def by_hand(rows, percent, size):
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            common = Counter(j for t in s for j in holders[t])
            for j, both in common.items():
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
            for t in s:
                holders[t].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows))


def prose(r, n):
    return ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(r, words, share):
    return [r.choice(prose(r, 3)) if r.random() < share else w for w in words]


def corpus():
    r = random.Random(11)
    passages = [prose(r, 50) for _ in range(4)]
    rows = []
    for k in range(260):  # texts of their own, many with shared passages, some made of passages only
        words = [] if k % 13 == 0 else prose(r, r.randint(1, 150))
        for p in r.sample(passages, r.choice([0, 1, 1, 2])):
            words = words + p
        rows.append(words)
    for size in (2, 3, 30, 150):  # families of near copies on both sides of the threshold, chains included
        words = prose(r, 200)
        for k in range(size):
            rows.append(edited(r, rows[-1] if k % 5 == 1 else words, r.choice([0.0, 0.005, 0.01, 0.02, 0.04])))
    texts = [r.choice([" ", "\n"]).join(w) for w in rows]
    texts += [t.upper() for t in texts[:10]] + ["", None, " \t ", "one", "One", "a b", "a  b", "a b c", "A B C", "x " * 20_000, "x y " * 10_000]
    r.shuffle(texts)
    return [(k * 3 % 10_007, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None), (0, texts[5]), (0, texts[0])]


def test_against_brute_force(make):
    rows = corpus()
    for percent, size in ((85, 4), (80, 5)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), percent, size).collect())
        assert got == by_hand(rows, percent, size)


def test_frequent_tokens_at_a_low_bound(make, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    rows = corpus()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), 85, 4).collect())
    assert got == by_hand(rows, 85, 4)


def test_empty(make):
    assert jaccard.jaccard_components(make([])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(make([(7, None)])).collect()] == [(7, 0, 7)]


def test_family_beyond_the_threshold_is_not_paired_off(make, monkeypatch):
    r = random.Random(5)
    words = prose(r, 150)
    rows = [(0, " ".join(words))]
    for k in range(1, 240):  # three to five words changed: too many for a link to the original or to each other
        copy = list(words)
        for at in r.sample(range(4, 146), r.randint(3, 5) if k % 20 else 1):
            copy[at] = f"own{k}x{at}"
        rows.append((k, " ".join(copy)))
    seen = {}

    def spy(df, name="table", *args, put=jaccard.written):
        out = put(df, name, *args)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), 85, 4).collect())
    assert got == by_hand(rows, 85, 4)
    assert max(component for *_, component in got) > 200
    assert seen["class-pairs"][-1] < 4 * len(rows)
    assert seen["group-pairs"][-1] < 4 * len(rows)


def test_family_that_lacks_words_is_not_paired_off(make, monkeypatch):
    r = random.Random(6)
    words = prose(r, 160)
    rows = [(0, " ".join(words))]
    for k in range(1, 240):  # four words less: 28 apart from the original, 56 from each other, but only 24 own tokens
        gone = r.sample(range(5, 155, 5), 4 if k % 20 else 1)
        rows.append((k, " ".join(w for at, w in enumerate(words) if at not in gone)))
    seen = {}

    def spy(df, name="table", *args, put=jaccard.written):
        out = put(df, name, *args)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), 85, 4).collect())
    assert got == by_hand(rows, 85, 4)
    assert max(component for *_, component in got) > 200
    assert seen["class-pairs"][-1] < 16 * len(rows)  # mostly pairs that lack a word in common; 4,875 by place and size alone
