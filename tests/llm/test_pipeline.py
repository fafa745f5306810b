import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from marketprose.llm import bpe
from marketprose.llm.queries import QUERIES

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_quality": "doc_id held_out score predicted",
    "op4_html": "page_id url text n_chars",
    "op5_jaccard": "doc_id n_shingles component_id",
    "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_near_vectors": "vec_id n_links component_id kept",
    "op8_token_shards": "doc_id start n_tokens ids_crc32",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_queries(spark):
    assert set(QUERIES) == set(CONTRACT)
    for name, columns in CONTRACT.items():
        got = QUERIES[name](spark, SF)
        assert set(columns.split()) <= set(got.columns), name
        source = "pages" if "page_id" in columns else "embeddings" if "vec_id" in columns else "documents"
        if name == "op12_collocations":
            assert got.filter("score > 1000000 OR a < 30 OR l < a OR r < a OR n < l").count() == 0 < got.count()
            continue
        got = got.select("doc_id").distinct() if name == "op11_packing" else got
        assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count(), name


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        steps.append(docs.collect())
    kept = {r.doc_id for r in steps[0]}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d not in kept for d, q in labels.items() if q == 0) >= 0.7 * sum(q == 0 for q in labels.values())
    texts = [r.text for r in steps[1]]
    assert len(texts) == len(set(texts)) and {r.text for r in steps[0]} >= set(texts)
    copies = [sum(x.doc_id == r.doc_id for x in steps[2]) for r in steps[1]]
    assert max(copies) <= 2
    ranks = bpe.codec(*corpus_pipeline.TOKENS).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()}
    for r in steps[2]:
        ids = np.array(library.encode_ordinary(r.text), "<u4")
        assert last[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_and_edges(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "a b c d e f g", None, None, 13), (3, "w " * 50_000, "en", "a", 100_000), (3, "w " * 50_000, "en", "a", 100_000)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 3}  # without labels nothing is rejected; texts without words are in no mix
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_texts_come_in_small_batches(spark):
    def lengths(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)], "size": [int(batch["text"].str.len().sum())]})

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:1]:
        stage(spark, docs, SF)
    short = spark.range(0, 5000, numPartitions=1).selectExpr("'x' AS text").mapInPandas(lengths, "rows int, size bigint").collect()
    assert sum(r.rows for r in short) == 5000 and max(r.rows for r in short) <= 1000
    long = spark.range(0, 40, numPartitions=1).selectExpr("repeat('x', 1048576) AS text").mapInPandas(lengths, "rows int, size bigint").collect()
    assert sum(r.rows for r in long) == 40 and max(r.size for r in long) <= 10 << 20
