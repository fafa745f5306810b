"""Table files: CSV in and out, Parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_table_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header row, doubled quotes and, with ``multi_line``, line breaks inside quotes.

    Such line breaks make a file one task; turn them off for large single files without any.

    With a schema, columns are matched by the header's names. Without one the types are inferred over
    the whole file. A first column without a name (a saved row index) is dropped.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
        return df.drop("_c0") if df.columns[:1] == ["_c0"] else df
    fields = {f.name: f for f in _struct(schema).fields}
    header = reader.csv(path).columns  # names only: nothing but the header is read
    names = ["_c0" if i == 0 and not name else name for i, name in enumerate(header)]
    layout = T.StructType([fields.get(name, T.StructField(name, T.StringType())) for name in names])
    df = reader.option("enforceSchema", True).schema(layout).csv(path)
    return df.select(*[F.col(n) if n in names else F.lit(None).cast(f.dataType).alias(n) for n, f in fields.items()])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    rows_per_file: int = 1_000_000,
) -> str:
    """Write Parquet, or CSV that ``read_table_csv`` reads back; no row index is written.

    CSV files hold at most ``rows_per_file`` rows, so that each stays one moderate task to read.
    """
    if fmt == "parquet":
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    elif fmt == "csv":
        flat = [
            F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
        # blanks at the edges of a text are kept; empty text is read back as null
        out = df.select(*flat).write.mode(mode).partitionBy(*partition_by).option("header", True).option("escape", '"')
        out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        out.option("maxRecordsPerFile", rows_per_file).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def spread(df: DataFrame) -> DataFrame:
    """Deal a plain scan out to all cores when its files split into fewer tasks than there are cores.

    Large tables have splits enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_tables(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Tables stacked by column name; columns a table lacks are null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
