import hashlib
import random

import numpy as np
from marketprose.llm import sketch


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 9))) for _ in range(words))


def test_likeness_follows_the_texts():
    a, b = prose(1, 2000), prose(2, 2000)
    one, two = (sketch.to_string(t, sketch.sketch(t)) for t in (a, b))
    assert sketch.likeness(one, one) == 1.0
    assert sketch.likeness(one, two) < 0.02
    edited = sketch.edited_text(a, b)
    mark = sketch.to_string(edited, sketch.sketch(edited))
    true = len({a[i : i + 16] for i in range(len(a) - 15)} & {edited[i : i + 16] for i in range(len(edited) - 15)}) / (len(a) - 15)
    assert abs(sketch.likeness(one, mark) - true) < 0.05


def test_unequal_lengths_and_merging():
    short, rest = prose(3, 300), prose(4, 20_000)
    whole = sketch.sketch(short + " " + rest)
    assert sketch.containment(sketch.sketch(short), whole) > 0.9
    assert sketch.containment(whole, sketch.sketch(short)) < 0.05
    union = sketch.merged(sketch.sketch(short), sketch.sketch(rest))
    assert len(np.setdiff1d(whole, union)) <= 8  # only shingles over the seam
    text = sketch.to_string(short, sketch.sketch(short))
    assert (sketch.from_string(text) == sketch.sketch(short)).all()


def test_fixed_fraction():
    values = sketch.shingle_values(prose(5, 50_000))
    assert abs(len(sketch.sketch(prose(5, 50_000))) / len(np.unique(values)) - 1 / sketch.SCALED) < 0.005
    assert len(sketch.sketch("")) == 0


def test_next_documents(make):
    rows = [(k * 7 % 3001, prose(k, 1 + k % 40)) for k in range(3001)]
    rows += [(4000, None), (4001, ""), (4002, "abc"), (4003, rows[0][1]), (4004, rows[0][1]), (4005, "漢字🚀" * 30), (4006, "z" * 30_000)]
    order = sorted(rows)[:3001] + rows[3001:]
    got = {r.doc_id: r for r in sketch.compare_with_next(make(rows, 5)).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(order):
        own, following = text or "", order[(i + 1) % len(order)][1] or ""
        quarter = len(own) // 4
        want = own[: len(own) - quarter] + following[:quarter]
        assert got[doc].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[doc].n_chars == len(own)
    assert got[4003].fingerprint == got[4004].fingerprint and got[4003].near_next == 1.0
    assert got[4000].near_next == 1.0  # both empty


def test_edges(make):
    assert sketch.compare_with_next(make([])).count() == 0
    one = sketch.compare_with_next(make([(1, "alone in the table")])).first()
    assert one.near_next == 1.0
    nulls = sketch.compare_with_next(make([(None, "a b c d"), (None, None), (3, "x"), (3, "x")])).collect()
    assert len(nulls) == 4
    assert sketch.compare_with_next(make([(None, "only nulls here")])).first().near_next == 0.0
    same = sketch.fingerprints(make([(1, "same text"), (2, "same text"), (3, None)])).collect()
    assert len({r.fingerprint for r in same if r.doc_id < 3}) == 1
