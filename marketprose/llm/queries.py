"""Queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketprose.llm import bpe, collocations, html, jaccard, lm, mixing, neighbours, packing, quality, runs, sketch, warc, wavelet
from marketprose.llm.common import remainder
from marketprose.session import ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def three_weights(sources: list[str | None]) -> list[float]:
    """3, 1, 2 and so on in turn."""
    return [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    mix = mixing.Mix(table(spark, sf_dir, "documents"), three_weights)
    targets = mix.targets.select("source_no", "source_size", "target")
    taken = mix.taken().join(targets, "source_no")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", F.array_sort("shards").alias("shards"))


@query
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under a trigram model of the documents that are not held out."""
    return lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2, order=3)


KEEP_FROM = 0.3


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = quality.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the field trained on labelled pages."""
    return html.extract(table(spark, sf_dir, "pages"), html.default_field())


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets and components of documents at Jaccard 0.85 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 85, 4)


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors among embeddings with equal labels, cosine 0.98 or more."""
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), 0.98).vectors


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from the wavelet-matrix files: start, number of ids, crc32 of the ids."""
    files = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(files, ids=False).drop("ids")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC files and the converter to WARC files, read back."""
    files = warc.arc_to_warc(warc.write_arc(table(spark, sf_dir, "pages")))
    records = written(warc.read_warc(files).drop("payload"), "warc-records")
    return warc.with_targets(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the rank file, and what they decode to."""
    rules = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), *rules)
    return bpe.decode_ids(encoded, *rules).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1,024 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, percent=80, top=2000)


def planted_repeat(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a tenth of the documents starts to repeat itself, and with which period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and the text without the repeats."""
    found = runs.collapse_runs(table(spark, sf_dir, "documents"), least=24, times=3, edit=planted_repeat)
    best = F.get("runs", F.col("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * get(runs, best).length div get(runs, best).period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
