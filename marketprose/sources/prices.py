"""Daily price documents: one landed JSON chart per ticker and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketprose.functions.dates import compact_date, epoch_to_timestamp
from marketprose.operators.select import once, stamp, unnest
from marketprose.sources import schemas


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """Landed chart documents, one file each: (ticker, body); the file is named after the ticker."""
    raw = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    return raw.select(F.regexp_extract("_file", r"([^/]+?)(?:[-_.][^/]*)?$", 1).alias("ticker"), F.col("value").alias("body"))


def price_chart_to_rows(charts: DataFrame, table_name: str = "daily_price") -> DataFrame:
    """One row per bar of the first result in each chart (ticker, body).

    The parallel arrays are zipped inside the row; values missing from one of them are null, and
    documents without a result give no rows.
    """
    chart = F.from_json("body", schemas.CHART)
    first = F.get(chart["chart"]["result"], 0)
    parsed = once(charts, "r", first).select(
        "ticker",
        F.col("r.timestamp").alias("timestamp"),
        F.get("r.indicators.quote", 0).alias("q"),
        F.get("r.indicators.adjclose", 0)["adjclose"].alias("adjclose"),
    )
    empty = F.array().cast("array<double>")
    columns = [F.coalesce(F.col(f"q.{n}"), empty).alias(n) for n in ("open", "high", "low", "close")]
    zipped = F.arrays_zip(
        "timestamp",
        *columns,
        F.coalesce("adjclose", empty).alias("adjclose"),
        F.coalesce(F.col("q.volume"), F.array().cast("array<bigint>")).alias("volume"),
    )
    bars = unnest(parsed, ["ticker"], zipped, "bar")
    when = epoch_to_timestamp(F.col("bar.timestamp"))
    rows = bars.filter("bar.timestamp IS NOT NULL").select(
        when.alias("timestamp"),
        *[F.col(f"bar.{n}").alias(n) for n in ("open", "high", "low", "close", "adjclose", "volume")],
        compact_date(when).alias("datetime"),
        F.year(when).alias("year"),
        F.month(when).alias("month"),
        F.dayofmonth(when).alias("day"),
        "ticker",
    )
    return stamp(rows, table_name=table_name)
