import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from marketprose.llm import wavelet
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("top", [1, 2, 7, 300, 50_256, 70_000])
def test_matrix(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 5, 63, 64, 511, 512, 513, 3000):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = wavelet.Shard(wavelet.pack_shard([1], [n], ids))
        matrix = shard.matrix
        assert (matrix.unpack() == ids).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (matrix.access(at) == ids[at]).all()
        for value in [*ids[:4].tolist(), top - 1, top + 5]:
            places = np.flatnonzero(ids == value).tolist()
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert matrix.count(value) == len(places)
            assert matrix.count(value, lo, hi) == sum(lo <= p < hi for p in places)
            assert [matrix.select(value, k) for k in range(min(6, len(places)))] == places[:6]
            assert matrix.select(value, len(places)) == -1


def test_pieces_encode_as_whole_texts(library):
    r = random.Random(2)
    encode = wavelet.PieceEncoder(PATH, limit=20_000)
    texts = ["", " ", " a", "a ", "a  b", "<|endoftext|> x", "x" * 3000 + " y", "don't  stop\n 漢 🚀"]
    texts += ["".join(r.choice("abe  \n\t.'1é🚀") for _ in range(r.randint(0, 120))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(make, library, tmp_path):
    rows = [(5, "five words are in here"), (2, None), (9, ""), (None, "no id"), (3, "b b b " * 500), (3, "a again"), (7, "x" * 50_000)]
    for size in (1, 700, 1 << 22):
        files = wavelet.write_shards(make(rows), PATH, folder=f"file://{tmp_path}/{size}", shard_tokens=size)
        assert files.agg({"docs": "sum"}).first()[0] == len(rows)
        assert (files.count() == len(rows)) == (size == 1)
        got = wavelet.read_shards(files).orderBy("start").collect()
        start = 0
        for row, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(ids))
            assert zlib.crc32(bytes(row.ids)) == zlib.crc32(ids.tobytes())
            start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(make([]), PATH)).count() == 0


def test_many_buckets_keep_the_order(make):
    rows = [(k * 37 % 5003, f"text {k}") for k in range(5003)]
    files = wavelet.write_shards(make(rows, 5), PATH)
    assert files.select("bucket").distinct().count() > 1
    got = wavelet.read_shards(files).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(5003))
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()


def test_damage():
    content = wavelet.pack_shard([1], [3], np.array([1, 2, 3], np.uint32))
    with pytest.raises(ValueError):
        wavelet.Shard(b"XXXX" + content[4:])
