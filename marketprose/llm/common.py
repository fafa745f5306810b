"""Small shared pieces: word hashes, ordered buckets, files in the shared folder."""

from __future__ import annotations

import ctypes
import os
import posixpath
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketprose.llm.pretokens import ByteCache
from marketprose.session import scratch_path


class Recent(dict):
    """Key to value, computed when first seen and remembered up to ``limit`` bytes; then it starts anew.

    Bounds memory, never results. ``forget_recent`` empties all such tables; tasks that fill them do so at their ends,
    since the worker lives on.
    """

    ENTRY = 140  # a slot of the table, a share of its spare room, and the value
    tables: list[Recent] = []

    def __init__(self, limit: int = 24 << 20):
        self.limit, self.used = limit, 0
        Recent.tables.append(self)

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        self.used += sys.getsizeof(key) + self.ENTRY
        if self.used > self.limit:
            self.forget()
        value = self[key] = self.compute(key)
        return value

    def forget(self) -> None:
        self.clear()
        self.used = 0


class Hashes(Recent):
    """64-bit hash of a word."""

    def compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_HASHES = Hashes()


def forget_recent() -> None:
    """Empty what this worker remembers, also from the stages before, and hand the memory back to the system."""
    for table in Recent.tables:
        table.forget()
    for table in ByteCache.tables:
        if (known := table()) is not None:
            known.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.encode().lower().split()


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = values ^ (values >> np.uint64(30))
    x = x * _ODD[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of the whole sequence when it is shorter."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    out = np.full(last, np.uint64(n))
    for k in range(n):
        out = mixed(out * _ODD[0] + hashes[k : k + last])
    return np.unique(out)


def remainder(key: str, mod: int) -> Column:
    """crc32 of a column's decimal text, modulo ``mod``; -1 for a null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(-1))


def ordered_buckets(
    df: DataFrame, key: str, rows_per_bucket: int = 1024, leads: bool = True, wrap: bool = False
) -> DataFrame:
    """``df`` with columns ``bucket``, which never falls as ``key`` grows, and ``lead``.

    The rows with the first key of a bucket come a second time, marked ``lead``, in the nearest earlier bucket that
    has rows: whoever walks a bucket in order also sees what follows its last row. Null keys come first. The bounds
    are quantiles of the key column, rows / rows_per_bucket of them and at most 10,000, so they and the heads fit
    anywhere. Without ``leads`` there are no second copies; with ``wrap`` the smallest key also follows the last bucket.
    """
    parts = int(min(10_000, max(1, df.count() // rows_per_bucket)))
    cuts = np.unique(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [])

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, keys.fillna(-np.inf).to_numpy(float), side="right")
        return pd.Series(found.astype(np.int32))

    placed = df.withColumn("bucket", place(F.col(key))).withColumn("lead", F.lit(False))
    if not leads:
        return placed
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min(key)).collect())
    heads = [(first, earlier) for (earlier, _), (_, first) in zip(firsts, firsts[1:], strict=False)]
    known = [r for r in firsts if r[1] is not None]
    if wrap and known:
        heads.append((known[0][1], firsts[-1][0]))
    if not heads:
        return placed
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(heads, f"_first {dict(df.dtypes)[key]}, _before int"))
    ahead = placed.join(table, F.col(key) == F.col("_first"))
    ahead = ahead.withColumns({"bucket": F.col("_before"), "lead": F.lit(True)}).drop("_first", "_before")
    return placed.unionByName(ahead)


def walked(df: DataFrame, *order: str) -> DataFrame:
    """Buckets dealt out to tasks, each in order; the lead rows last."""
    return df.repartition("bucket").sortWithinPartitions("bucket", "lead", *order)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by a key to as many tasks as the session shuffles to, however few bytes they have.

    For rows that stand for much work; adaptive execution would merge them into few tasks by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def frames(batches: Iterable[pd.DataFrame], key: str = "bucket") -> Iterator[tuple[object, pd.DataFrame]]:
    """Batches of rows sorted by ``key``, cut where the key changes."""
    for batch in batches:
        for value, rows in batch.groupby(key, sort=False):
            yield value, rows


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared one; it goes when the session's scratch tables go."""
    return scratch_path(spark, name)


def put_file(path: str, content: bytes) -> None:
    """Write a file of a shared folder whole or not at all; a task that runs twice writes the same file twice."""
    files, local = filesystem(path)
    files.create_dir(posixpath.dirname(local), recursive=True)
    draft = f"{local}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, local)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path: hdfs, s3, gs, file, or a plain absolute path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def as_key(name: str) -> Column:
    """An integer key as text, the form in which it passes through pandas: beside a null, pandas would make it a float."""
    return F.col(name).cast("bigint").cast("string")


def keyed(df: DataFrame, name: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """The key back as a number."""
    return df.withColumn(name, F.col(name).cast(kind))
