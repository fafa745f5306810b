import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from marketprose.llm import bpe

RULES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*RULES)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=RULES[1], mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    r = random.Random(5)
    out = ["", " ", "a", "  two  spaces ", "don't we'll\n\n\tx", "漢字🚀é", "<|endoftext|>", "a" * 4000, "ab" * 6000, " " * 900 + "x", "　a b"]
    out += ["".join(r.choice("abcdehinorst  \n'.1é🚀") for _ in range(r.randint(1, 300))) for _ in range(300)]
    return out


def test_encode_as_the_library(codec, library):
    for text in texts():
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_queue_gives_lowest_rank_then_leftmost():
    queue = bpe.RankQueue(1000)
    entries = [(700, 4), (3, 9), (3, 2), (256, 1), (999, 0), (3, 5), (255, 7)]
    for rank, position in entries:
        queue.push(rank, position)
    assert [queue.pop() for _ in entries] == sorted(entries)
    assert queue.pop() == (-1, -1)


def test_ties_and_stale_pairs():
    small = bpe.Codec({b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}, ".+")
    library = tiktoken.Encoding("tiny", pat_str=".+", mergeable_ranks=small.ranks, special_tokens={})
    for n in range(1, 12):
        for bits in range(2**n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            assert small.encode(text) == library.encode_ordinary(text)


def test_unknown_id(codec):
    with pytest.raises(KeyError):
        codec.decode([50_256])


def test_tables(make, library):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (None, "x y"), (1, "the cat sat"), (4, "z" * 100_000)]
    got = bpe.decode_ids(bpe.encode_texts(make(rows), *RULES), *RULES).collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want = (doc, len(ids), hashlib.sha256(packed).hexdigest(), (text or "").encode(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in [(r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.decoded), r.decoded_sha256) for r in got]
    assert bpe.decode_ids(bpe.encode_texts(make([]), *RULES), *RULES).count() == 0
