"""The corpus pipeline: quality, near duplicates, mix, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketprose.llm import bpe, jaccard, mixing, quality
from marketprose.llm.common import remainder
from marketprose.llm.queries import KEEP_FROM, three_weights
from marketprose.operators.lookups import keyed_join
from marketprose.session import ship, small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def prepare(spark: SparkSession) -> None:
    """The package on the workers, and whole texts in small batches: executors also hold what the stage before left."""
    ship(spark)
    small_batches(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_labelled(docs.select("doc_id", "text"), labels, remainder("doc_id", 5) != 0)
    return quality.score(docs.select(*COLUMNS), model, name="_score").filter(F.col("_score") >= KEEP_FROM).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near copies, Jaccard 0.8 or more: that with the smallest id.

    Documents without words have no shingles and all stay, as do rows without an id; of rows that repeat id and text
    one stays.
    """
    prepare(spark)
    found = jaccard.jaccard_components(docs, percent=80, size=5)
    kept = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = written(kept, "kept-ids")
    chosen = keyed_join(docs.select(*COLUMNS), kept, "doc_id", "inner")
    once = chosen.filter("_rows = 1").unionByName(chosen.filter("_rows > 1").dropDuplicates(["doc_id", "text"]))
    return once.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: weights 3, 1, 2 in turn, half as many words again in all."""
    prepare(spark)
    return mixing.Mix(docs, three_weights).documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    prepare(spark)
    return bpe.decode_ids(bpe.encode_texts(docs, *TOKENS), *TOKENS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
