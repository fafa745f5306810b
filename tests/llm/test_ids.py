"""Ids beyond 2^53 beside null ids, and columns with clashing names, through every operator."""

import public_tokenizers
import pytest
from marketprose.llm import bpe, html, jaccard, lm, mixing, packing, runs, sketch, warc, wavelet
from marketprose.llm.common import remainder

BIG = [2**60 + k for k in (1, 2, 3)] + [-(2**62) - 1]
TEXTS = ["one two three four five", "six seven eight nine ten", "one two three four five", "else"]
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

OPERATORS = {
    "mixing": lambda d: mixing.Mix(d, lambda s: [1.0] * len(s)).taken(),
    "lm": lambda d: lm.score(d, remainder("doc_id", 7) != 2, order=3),
    "jaccard": lambda d: jaccard.jaccard_components(d, 85, 4),
    "sketch": sketch.compare_with_next,
    "fingerprints": sketch.fingerprints,
    "wavelet": lambda d: wavelet.read_shards(wavelet.write_shards(d, JSON)),
    "bpe": lambda d: bpe.decode_ids(bpe.encode_texts(d, *RANKS), *RANKS),
    "packing": lambda d: packing.pack(d, JSON),
    "runs": runs.collapse_runs,
    "html": lambda d: html.extract(d, html.default_field(), key="doc_id", url="source", html="text").withColumnRenamed("page_id", "doc_id"),
    "warc": lambda d: warc.with_targets(
        warc.read_warc(warc.arc_to_warc(warc.write_arc(d, key="doc_id", url="source", html="text")))
    ).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_big_ids_beside_null(make, name):
    rows = [*zip(BIG, TEXTS, strict=True), (None, "no id here"), (None, None)]
    got = sorted(str(r.doc_id) for r in OPERATORS[name](make(rows, 1)).collect())
    assert got == sorted(str(k) for k, _ in rows)


def test_components_and_targets_keep_big_ids(make):
    long = "text that is long enough to be stored once only " * 4
    rows = [(BIG[0], long), (BIG[1], long), (None, long), (None, None)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make(rows, 1), 85, 4).collect()}
    assert found == {BIG[0]: BIG[0], BIG[1]: BIG[0], None: None}
    files = warc.arc_to_warc(warc.write_arc(make(rows, 1), key="doc_id", url="source", html="text"))
    targets = {(r.page_id, r.refers_to) for r in warc.with_targets(warc.read_warc(files)).collect()}
    assert targets == {(BIG[0], None), (BIG[1], BIG[0]), (None, BIG[0]), (None, None)}
