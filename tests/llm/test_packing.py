import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from marketprose.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cheapest(at, cost, window, per_window):
    """Every window against every other."""
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            length = int(at[j] - at[i])
            if length <= window:
                best[j] = min(best[j], best[i] + packing.padding(length, window) + cost[j] + per_window)
    return best[-1]


@pytest.mark.parametrize("window", [1, 4, 32, 256])
def test_cuts_are_the_cheapest(window):
    rng = np.random.default_rng(window)
    for n in (1, 2, 7, 60, 200):
        for _ in range(6):
            at = np.cumsum(np.concatenate([[0], rng.integers(1, max(2, window // rng.integers(1, 5) + 1), n)]))
            at = at[np.concatenate([[True], np.diff(at) <= window])]
            cost = rng.choice([0.0, 4.0, 16.0], len(at))
            per = float(rng.choice([0, 1]))
            chosen, total = packing.cuts(at, cost, window, per)
            assert chosen[0] == 0 and chosen[-1] == len(at) - 1
            lengths = np.diff(at[chosen])
            assert (lengths > 0).all() and (lengths <= window).all()
            own = sum(packing.padding(int(n), window) for n in lengths) + cost[chosen[1:]].sum() + per * len(lengths)
            assert own == pytest.approx(total) == pytest.approx(cheapest(at, cost, window, per))


def test_positions():
    closes = np.array([False, True, False])
    ids = np.array([0, 1, 0, 0, 0, 0, 0, 2, 0, 1, 2])
    at, cost = packing.positions(ids, np.array([8, 11]), closes, (4.0, 16.0), 3)
    assert at.tolist() == [0, 2, 5, 8, 10, 11]
    assert cost.tolist() == [0, 4, 16, 0, 4, 0]
    assert packing.sentence_ends(PATH)[Tokenizer.from_file(PATH).encode(".").ids[0]]


def sample(n=400):
    r = random.Random(4)
    words = ["and", "so", "it", "went.", "on!", "ö", "漢字", "'tis", "x1", "\n"]
    rows = [(k * 11, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 9, 90, 1500])))) for k in range(n)]
    long = " ".join(f"w{r.random()}" for _ in range(30_000))
    return [*rows, (2**60 + 1, None), (2**60 + 2, "x" * 40_000), (None, "no id"), (None, None), (3, long), (3, "twice"), (3, "twice")]


@pytest.mark.parametrize("chain", [1, 5_000, 1 << 20])
def test_pieces_hold_every_id_once(make, chain):
    library, rows = Tokenizer.from_file(PATH), sample()
    got = packing.pack(make(rows), PATH, chain_tokens=chain).collect()
    documents, windows = {}, {}
    for p in got:
        documents.setdefault((p.doc_id, p.row, p.doc_tokens), []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    found = []
    for (doc, _, total), parts in documents.items():
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at
            at += len(p.ids) // 4
        assert at == total
        found.append((doc, zlib.crc32(b"".join(bytes(p.ids) for p in parts))))
    wanted = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((doc, zlib.crc32(ids.tobytes())))
    assert sorted(found, key=str) == sorted(wanted, key=str)
    padded = 0
    for parts in windows.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += len(p.ids) // 4
        assert 0 < at <= 1024
        padded += packing.padding(at)
        # documents keep their order inside a window
        keys = [(p.doc_id is not None, p.doc_id or 0, p.row) for p in parts]
        assert keys == sorted(keys)
    if chain > 1:
        assert padded < 0.02 * sum(len(p.ids) // 4 for p in got)


def test_empty_and_bad_windows(make):
    assert packing.pack(make([]), PATH).count() == 0
    assert [r.ids for r in packing.pack(make([(1, "")]), PATH).collect()] == [b"\0\0\0\0"]
    with pytest.raises(ValueError):
        packing.pack(make([]), PATH, window=1000)
