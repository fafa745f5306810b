"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_PATHS: dict[str, list[str]] = {}  # what each application has written to the shared folder


def build_session(app: str = "marketprose", **conf: str) -> SparkSession:
    """A session with the settings this package assumes; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the stream's set of seen links grows past what fits in the heap
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        # iterative fits leave a checkpoint per step; let Spark drop those no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may go without; it gets a folder of its own below the warehouse, for as long as it runs.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    folder = os.path.join(warehouse, f"_scratch-{uuid.uuid4().hex}")
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, in the shared folder."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query run inside the block deletes its shuffle files when it ends, not when the driver happens to collect garbage.

    For queries whose rows are stored: nothing reads those files again, and iterations would pile them up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Cuts the lineage, survives lost executors, and gives later joins a known size. The table stays until it is
    discarded, or until its ``scratch`` block or ``clear_scratch`` ends it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            _delete(table.sparkSession, [path])
            _PATHS[table.sparkSession.sparkContext.applicationId].remove(path)


def clear_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Delete everything written to the shared folder by this session, but the ``keep`` oldest."""
    paths = _PATHS.get(spark.sparkContext.applicationId, [])
    _delete(spark, paths[keep:])
    del paths[keep:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block is deleted at its end; results must be stored elsewhere by then."""
    before = len(_PATHS.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clear_scratch(spark, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, with the partitioning kept."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new plan, made inside the block


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """From now on tasks hand rows to Python in batches of at most so many rows and bytes.

    For whole texts: the default, 10,000 rows, is tens of MB that a task holds on both sides at once, and several times.
    """
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(records)) <= rows:
        spark.conf.set(records, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per Spark context, where the cluster has not installed it."""
    context = spark.sparkContext
    if getattr(context, "_marketprose_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="marketprose-py-")) / "marketprose.zip"  # the driver serves it to executors
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._marketprose_shipped = True
