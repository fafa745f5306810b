import math

import numpy as np
import pytest
from marketprose.llm import mixing

WEIGH = lambda sources: [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 1, 1], 300, 2) == [100, 100, 100]
    got = mixing.water_fill([10, 100, 100], [3, 1, 2], 315, 2)
    assert got == pytest.approx([20, 295 / 3, 590 / 3])
    assert mixing.water_fill([], [], 0, 2) == []
    assert mixing.water_fill([0, 5], [3, 1], 7.5, 2) == [0, 7.5]


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree(shards):
    tree = mixing.SplittingTree([400, 0, 37, 1200], shards, seed=3)
    quotas = np.array([tree.quotas(s) for s in range(shards)])
    assert quotas.sum(0).tolist() == [400, 0, 37, 1200]
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 2  # shards are of one size
    source = np.repeat([0, 2, 3], [400, 37, 1200])
    block = np.concatenate([np.arange(n) for n in (400, 37, 1200)])
    places = [tree.permuted(np.full(n, s), np.arange(n)) for s, n in ((0, 400), (2, 37), (3, 1200))]
    assert all(sorted(p.tolist()) == list(range(len(p))) for p in places)
    found = mixing.SplittingTree([400, 0, 37, 1200], shards, seed=3).shard(source, block)
    counts = np.zeros((shards, 4), int)
    np.add.at(counts, (found, source), 1)
    assert (counts == quotas).all()
    part = mixing.SplittingTree([400, 0, 37, 1200], shards, seed=3).shard(source[50:60], block[50:60])
    assert (part == found[50:60]).all()  # whoever asks, and for whatever blocks, gets the same shard


def test_mix(make):
    rows = [(k, "w " * (1 + k % 50), "abc"[min(k % 20, 2)]) for k in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "x\ty\nz", None), (1003, "v " * 5000, "c"), (1004, " ", None)]
    mix = mixing.Mix(make(rows), WEIGH, block_words=64, blocks_per_shard=16, bucket_rows=100)
    targets = {r.source_no: r for r in mix.targets.collect()}
    assert [targets[i].source for i in range(4)] == ["a", "b", "c", None]
    taken = mix.taken().collect()
    assert len(taken) == len(rows)
    words = {doc: len((text or "").split()) for doc, text, _ in rows}
    sums = dict.fromkeys(targets, 0)
    for r in taken:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sums[r.source_no] += r.taken
    for no, total in sums.items():
        assert abs(total - targets[no].target) <= 1
    assert sum(t.target for t in targets.values()) == pytest.approx(1.5 * sum(words.values()))
    pieces = mix.pieces.collect()
    assert all(0 < p.words <= 64 and p.first_word + p.words <= words[p.doc_id] for p in pieces)
    covered = [(p.doc_id, p.copy, w) for p in pieces for w in range(p.first_word, p.first_word + p.words)]
    assert len(covered) == len(set(covered))
    shards = {}
    for p in pieces:
        shards.setdefault(p.shard, []).append(p.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in shards.values())
    again = mixing.Mix(make(rows, 5), WEIGH, block_words=64, blocks_per_shard=16, bucket_rows=100)
    plain = lambda table: sorted((p.shard, p.source_no, p.block, p.doc_id, p.copy, p.first_word, p.words) for p in table)
    assert plain(again.pieces.collect()) == plain(pieces)
    out = mix.documents(make(rows))
    assert out.columns == make(rows).columns
    copies = {(r.doc_id): r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(copies.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2 for r in taken)


def test_results_come_through_the_tree(make, monkeypatch):
    rows = [(k, "w " * (1 + k % 50), "abc"[k % 3]) for k in range(300)]

    def broken(*_):
        raise RuntimeError("no tree")

    for name in ("shard", "left"):
        with monkeypatch.context() as patch:
            patch.setattr(mixing.SplittingTree, name, broken)
            if name == "left":
                assert mixing.SplittingTree([5, 5], 1).quotas(0).tolist() == [5, 5]  # no draw in a tree of one shard
            with pytest.raises(Exception):
                tree = mixing.SplittingTree([50, 50], 4)
                tree.shard(np.array([0, 1]), np.array([3, 4]))
    mix = mixing.Mix(make(rows), WEIGH, block_words=64, blocks_per_shard=4)
    moved = mix.tree.shard(np.array([r.source_no for r in mix.pieces.collect()]), np.array([r.block for r in mix.pieces.collect()]))
    assert moved.tolist() == [r.shard for r in mix.pieces.collect()]
    shards = {}
    for r in mix.pieces.collect():
        shards.setdefault(r.row, set()).add(r.shard)
    assert all(set(r.shards) == shards.get(r.row, set()) for r in mix.taken().collect())
    mix.pieces = mix.pieces.filter("shard > 0")  # what a shard lacks, the result lacks
    assert sum(r.taken for r in mix.taken().collect()) == sum(r.words for r in mix.pieces.collect())
    out = [(r.doc_id, r.source) for r in mix.documents(make(rows)).collect()]
    place = {}
    for r in mix.pieces.collect():
        place.setdefault((r.doc_id, r.copy), []).append((r.shard, r.position))
    first = {}
    for (doc, _), found in place.items():
        first.setdefault(doc, []).append(min(found))
    seen, order = {}, []
    for doc, _ in out:
        order.append(sorted(first[doc]).index(min(first[doc])) if doc not in first else sorted(first[doc])[min(seen.get(doc, 0), len(first[doc]) - 1)])
        seen[doc] = seen.get(doc, 0) + 1
    assert order == sorted(order)


def test_draws_follow_the_law(monkeypatch):
    """Draws of numpy and of the rejection for large counts against the exact probabilities."""
    good, bad, wanted = 30, 50, 20
    law = np.array([math.comb(good, k) * math.comb(bad, wanted - k) for k in range(wanted + 1)], float)
    law /= law.sum()
    for limit in (10**9, 0):
        monkeypatch.setattr(mixing, "NUMPY_DRAWS", limit)
        rng = np.random.default_rng(1)
        found = np.bincount([mixing.hypergeometric(rng, good, bad, wanted) for _ in range(20_000)], minlength=wanted + 1)
        assert np.abs(found / 20_000 - law).max() < 0.01
    monkeypatch.setattr(mixing, "NUMPY_DRAWS", 10**9)
    rng = np.random.default_rng(2)
    n = 4 * 10**10
    some = np.array([mixing.hypergeometric(rng, n // 4, 3 * n // 4, n // 2) for _ in range(2000)], float)
    sd = math.sqrt(n / 2 * 0.25 * 0.75 * 0.5)
    assert abs(some.mean() - n / 8) < 5 * sd / math.sqrt(2000) and 0.9 < some.std() / sd < 1.1
    assert mixing.hypergeometric(rng, 0, n, 5) == 0 and mixing.hypergeometric(rng, n, 0, 5) == 5 and mixing.hypergeometric(rng, n, n, 0) == 0


def test_scattered_is_a_permutation():
    for size in (1, 2, 3, 64, 65, 1000, 4097):
        out = mixing.scattered(np.arange(size), size, (1, 2))
        assert sorted(out.tolist()) == list(range(size))
    out = mixing.scattered(np.arange(4096), 4096, (3,))
    assert len(set(np.diff(out).tolist())) > 2000  # no constant stride


def test_edges(make):
    empty = mixing.Mix(make([]), WEIGH)
    assert empty.taken().count() == 0 and empty.pieces.count() == 0 and empty.documents(make([])).count() == 0
    none = mixing.Mix(make([(1, None, "a"), (2, "", None)]), WEIGH)
    assert [(r.size, r.taken) for r in none.taken().collect()] == [(0, 0), (0, 0)]
    rows = [(2**60 + 1, "a b c d", "s")] * 2 + [(2**60 + 1, "other text", "s")] + [(None, "e f", "s")] * 2
    twice = mixing.Mix(make(rows), WEIGH)
    got = twice.taken().collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 2), (0, 2), (2**60 + 1, 2), (2**60 + 1, 4), (2**60 + 1, 4)]
    assert sum(r.taken for r in got) == 21 and all(0 <= r.taken <= 2 * r.size for r in got)
    out = twice.documents(make(rows)).collect()
    assert {r.doc_id for r in out} <= {None, 2**60 + 1} and 5 <= len(out) <= 10
